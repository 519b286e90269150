"""DuckDB statements for the corpus queries that SQL can express on whole tables."""

from taktwerk.llm import licenses

OP4 = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT t, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT DISTINCT t, w FROM w)),
twice AS (SELECT t, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x, list(i) AS p FROM tri GROUP BY 1, 2 HAVING count(*) > 1),
places AS (SELECT DISTINCT t, q + j AS q FROM (SELECT t, unnest(p) AS q FROM twice), (SELECT unnest([0, 1, 2]) AS j)),
rep AS (SELECT t, count(*) AS n FROM places GROUP BY 1),
raw AS (SELECT t, unnest(string_split(t, chr(10))) AS line FROM (SELECT DISTINCT t FROM d)),
dup AS (SELECT t, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
norm AS (SELECT t, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line FROM raw),
lines AS (SELECT host, t, line, len(line) - len(replace(line, ' ', '')) + 1 AS n FROM norm JOIN (SELECT DISTINCT host, t FROM d) USING (t) WHERE line <> ''),
copies AS (SELECT host, t, count(*) AS copies FROM (SELECT DISTINCT host, t, doc_id FROM d) GROUP BY 1, 2),
bad AS (SELECT host, line FROM (SELECT DISTINCT host, t, line FROM lines) JOIN copies USING (host, t) GROUP BY 1, 2 HAVING sum(copies) > 10),
gone AS (SELECT l.host, l.t FROM lines l LEFT JOIN bad b ON l.host = b.host AND l.line = b.line GROUP BY 1, 2
         HAVING sum(CASE WHEN b.line IS NULL THEN l.n ELSE 0 END) < 0.3e0 * sum(l.n)),
base AS (SELECT w.doc_id, w.host, w.t, len(w.w)::BIGINT AS n_words, len(array_to_string(w.w, ''))::BIGINT AS word_chars,
         (len(w.t) - len(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN dup ON dup.t = w.t LEFT JOIN rep ON rep.t = w.t),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND gone.t IS NULL AS kept
FROM judged LEFT JOIN gone ON gone.host = judged.host AND gone.t = judged.t
"""

OP2 = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM ip),
dp AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
occ AS (SELECT r, i, k, item_id FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM dp) JOIN win USING (k, x)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY 1),
items AS (SELECT r, count(DISTINCT item_id) AS n, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS h FROM occ GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       coalesce(items.h, sha256('')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
f AS (SELECT part, [len(w) < 100, 100 * list_unique(w) < 80 * len(w), 100 * (len(t) - len(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * len(t),
             regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w JOIN firsts USING (t) LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS o FROM i a, i b, i x, i y, i z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
r AS (SELECT part, o, i AS step, f, f[o[i]] AS fails, len([j for j in o[1:i - 1] if f[j]]) > 0 AS gone, len([y for y in f if y]) = 1 AS lone, n, good, toxic FROM c, o, i),
s AS (SELECT part, o, step, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant,
             sum(n) FILTER (fails AND lone) AS unique_fails, sum(good) FILTER (NOT gone AND fails) AS good_lost, sum(toxic) FILTER (NOT gone AND fails) AS toxic_lost FROM r GROUP BY 1, 2, 3)
SELECT part, array_to_string([chr((64 + j)::INTEGER) for j in o], '') AS filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step])::BIGINT AS shapley FROM s
"""


def _spelled(x: str) -> str:
    for other, one in licenses.SPELLINGS:
        x = f"replace({x}, '{other}', '{one}')"
    return x


def op7() -> str:
    normal = f"regexp_replace(regexp_replace(lower(t), '(?m){licenses.COPYRIGHT}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    normal = _spelled(f"(' ' || replace({normal}, chr(10), ' ' || chr(10) || ' ') || ' ')")
    entire = f"trim(regexp_replace({_spelled("regexp_replace(n, '[ \\n]+', ' ', 'g')")}, ' +', ' ', 'g'))"
    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.KNOWN)
    return f"""
WITH k AS (SELECT DISTINCT license_id, {entire} AS form FROM (SELECT license_id, {normal} AS n FROM (VALUES {known}) v(license_id, t))),
d AS (SELECT doc_id, {normal} AS n FROM (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, string_split(n, chr(10)) AS l FROM d),
f AS (SELECT doc_id, 0 AS line, {entire} AS form FROM d
      UNION ALL SELECT doc_id, i AS line, trim(regexp_replace(l[i], ' +', ' ', 'g')) AS form FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l))
SELECT f.doc_id, f.line::INTEGER AS line, k.license_id FROM f JOIN k USING (form) WHERE form <> ''
"""


OP7 = op7()
