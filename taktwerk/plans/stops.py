"""Stop lists, search, neighbourhoods and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktwerk.functions.text import line_label, normal_product, product_flags, stop_code
from taktwerk.operators import pages as pages_op
from taktwerk.operators import stops as op
from taktwerk.operators.versioned import latest_version
from taktwerk.plans.params import Nearby
from taktwerk.plans.registry import query
from taktwerk.sources.fixtures import Fixtures

_COLUMNS = "vgnkennung, vagkennung, haltestellenname, latitude, longitude, produkt_bus, produkt_ubahn, produkt_tram, produkt_sbahn, produkt_rbahn"
_LISTED = (
    "SELECT vgnkennung, haltestellenname, latitude, longitude, array_to_string(vagkennung, ',') AS vagkennung,"
    " concat_ws(', ', CASE WHEN produkt_bus > 0 THEN 'Bus' END, CASE WHEN produkt_ubahn > 0 THEN 'UBahn' END, CASE WHEN produkt_tram > 0 THEN 'Tram' END) AS produkte FROM haltestellen"
)
LAT, LON = 49.45, 11.08


def _haversine(radius: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"2 * {radius} * atan2(sqrt({a}), sqrt(1 - {a}))"


_DISTANCE = _haversine("6371000e0", f"{LAT}e0", f"{LON}e0", "latitude", "longitude")


@query("all_stops", f"SELECT {_COLUMNS} FROM haltestellen")
def all_stops(t: Fixtures):
    return t.stops


@query("stop_product_csv", _LISTED)
def stop_product_csv(t: Fixtures):
    return op.listed(t.stops)


@query("stop_product_flags", f", l AS ({_LISTED}) SELECT vgnkennung, contains(produkte, 'Bus')::SMALLINT AS produkt_bus, contains(produkte, 'UBahn')::SMALLINT AS produkt_ubahn, contains(produkte, 'Tram')::SMALLINT AS produkt_tram, 0::SMALLINT AS produkt_sbahn, 0::SMALLINT AS produkt_rbahn FROM l")
def stop_product_flags(t: Fixtures):
    """Lists of modes turned back into flags."""
    flags = product_flags(F.col("produkte"))
    return op.listed(t.stops).select("vgnkennung", *[c.alias(n) for n, c in flags.items()])


@query("stop_product_overwrite", f", l AS ({_LISTED}) SELECT vgnkennung, (split_part(produkte, ', ', 1) = 'Bus')::SMALLINT AS produkt_bus, (split_part(produkte, ', ', 1) = 'Tram')::SMALLINT AS produkt_tram FROM l")
def stop_product_overwrite(t: Fixtures):
    """The flags that a writer who knows one mode leaves."""
    one = F.split("produkte", ", ")[0]
    return op.listed(t.stops).select("vgnkennung", (one == "Bus").cast("smallint").alias("produkt_bus"), (one == "Tram").cast("smallint").alias("produkt_tram"))


@query("stop_search", f", l AS ({_LISTED}) SELECT vgnkennung, haltestellenname FROM l WHERE regexp_matches(haltestellenname, '(?i)a.*e') AND regexp_matches(produkte, '(?i)b.s')")
def stop_search(t: Fixtures):
    return op.search(op.listed(t.stops), {"haltestellenname": "A%e", "produkte": "b_s"}).select("vgnkennung", "haltestellenname")


@query("stop_search_all", _LISTED)
def stop_search_all(t: Fixtures):
    return op.search(op.listed(t.stops), {})


@query("stop_by_code", f", l AS ({_LISTED}) SELECT vgnkennung, vagkennung FROM l WHERE regexp_matches(vagkennung, '(?i).*ECON.*') ORDER BY vgnkennung LIMIT 1")
def stop_by_code(t: Fixtures):
    """The first stop with a partial code."""
    return op.search(op.listed(t.stops), {"vagkennung": "%ECON%"}).orderBy("vgnkennung").limit(1).select("vgnkennung", "vagkennung")


@query("stop_by_id", f"SELECT {_COLUMNS} FROM haltestellen WHERE vgnkennung = 7")
def stop_by_id(t: Fixtures):
    return t.stops.where("vgnkennung = 7")


@query("stops_in_radius", f"SELECT vgnkennung, round({_DISTANCE}, 6) AS distanz FROM haltestellen WHERE {_DISTANCE} <= 2000")
def stops_in_radius(t: Fixtures):
    asked = Nearby(LAT, LON, 2000)
    return op.in_radius(t.stops, asked.latitude, asked.longitude, asked.radius).select("vgnkennung", F.round("distanz", 6).alias("distanz"))


@query("nearest_stops", f"SELECT vgnkennung, round({_DISTANCE}, 6) AS distanz FROM haltestellen WHERE {_DISTANCE} <= 5000 ORDER BY {_DISTANCE}, vgnkennung LIMIT 5")
def nearest_stops(t: Fixtures):
    return op.nearest(t.stops, LAT, LON, 5000).select("vgnkennung", F.round("distanz", 6).alias("distanz"))


@query("stop_codes", "SELECT vgnkennung, upper(trim(unnest(vagkennung))) AS code FROM haltestellen")
def stop_codes(t: Fixtures):
    return t.stops.select("vgnkennung", F.explode("vagkennung").alias("c")).select("vgnkennung", stop_code(F.col("c")).alias("code"))


@query("stops_with_products", f", l AS ({_LISTED}) SELECT vgnkennung FROM l WHERE contains(produkte, 'UBahn') OR contains(produkte, 'Tram')")
def stops_with_products(t: Fixtures):
    """Stops with any configured mode, compared without case, spaces and hyphens."""
    wanted = F.array(*[normal_product(F.lit(p)) for p in ("U-Bahn", "tram")])
    return op.listed(t.stops).where(F.arrays_overlap(F.transform(F.split("produkte", ","), normal_product), wanted)).select("vgnkennung")


_WEB = "SELECT vgnkennung, CASE WHEN vgnkennung % 10 = 0 THEN haltestellenname || '!' ELSE haltestellenname END AS web_name FROM haltestellen WHERE vgnkennung % 7 <> 0 UNION ALL SELECT (vgnkennung + 20000)::INTEGER, haltestellenname FROM haltestellen WHERE vgnkennung % 50 = 0"


@query("stop_name_check", f", w AS ({_WEB}) SELECT w.vgnkennung::INTEGER AS vgnkennung, CASE WHEN h.vgnkennung IS NULL THEN 'not found' ELSE 'violation' END AS finding FROM w LEFT JOIN haltestellen h USING (vgnkennung) WHERE h.haltestellenname IS NULL OR h.haltestellenname <> w.web_name")
def stop_name_check(t: Fixtures):
    """Names from elsewhere that differ from the table's, or are not in it."""
    s = t.stops.select(F.col("vgnkennung").cast("int").alias("vgnkennung"), "haltestellenname")
    web = s.where("vgnkennung % 7 <> 0").select("vgnkennung", F.when(F.col("vgnkennung") % 10 == 0, F.concat("haltestellenname", F.lit("!"))).otherwise(F.col("haltestellenname")).alias("web_name"))
    web = web.unionByName(s.where("vgnkennung % 50 = 0").select((F.col("vgnkennung") + 20000).alias("vgnkennung"), F.col("haltestellenname").alias("web_name")))
    return web.join(s, "vgnkennung", "left").where(F.col("haltestellenname").isNull() | (F.col("haltestellenname") != F.col("web_name"))).select("vgnkennung", F.when(F.col("haltestellenname").isNull(), "not found").otherwise("violation").alias("finding"))


_LINKS = "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', 1)) AS target, unnest(regexp_extract_all(html, '<a href=\"/([^\"]*)\">([^<]*)</a>', 2)) AS label FROM pages"


@query("page_options", _LINKS, prelude=False)
def page_options(t: Fixtures):
    """Choices of a navigation list in HTML: their targets and labels."""
    at = r'<a href="/([^"]*)">([^<]*)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(at), F.lit(1)).alias("target"), F.regexp_extract_all("html", F.lit(at), F.lit(2)).alias("label"))
    return t.raw("pages").select("page_id", F.explode(both).alias("x")).select("page_id", "x.target", "x.label")


#: The lists of a page by what precedes each link: as many opened as the list's number, for DuckDB.
_PAGE_LISTS = """WITH p AS (SELECT page_id, regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs') AS h FROM pages),
s AS (SELECT page_id, unnest(range(1, len(x) + 1)) AS i, x FROM (SELECT page_id, regexp_extract_all(h, '</?ul>|<a href="[^"]*">[^<]*') AS x FROM p)),
o AS (SELECT page_id, i, x[i] AS x, len(list_filter(x[1:i], lambda y: y = '<ul>')) AS opened, len(list_filter(x[1:i], lambda y: y = '</ul>')) AS closed FROM s),
c AS (SELECT page_id, opened AS list_no, (opened - closed) AS depth, i, x FROM o WHERE starts_with(x, '<a') AND opened > closed),
ch AS (SELECT page_id, list_no::INTEGER AS list_no, depth::INTEGER AS depth, row_number() OVER (PARTITION BY page_id, list_no ORDER BY i)::INTEGER AS place, regexp_extract(x, 'href="([^"]*)"', 1) AS target, trim(regexp_extract(x, '>(.*)', 1)) AS label FROM c WHERE NOT contains(x, 'href=""'))"""


@query("page_lists", _PAGE_LISTS + " SELECT page_id, list_no, depth, place, target, label FROM ch", prelude=False)
def page_lists(t: Fixtures):
    """The choices of each list of a page, in its order."""
    return pages_op.choices(t.raw("pages")).drop("list_id", "parent_no")


@query("page_stop_orders", _PAGE_LISTS + " SELECT page_id, list_no, 1::INTEGER AS direction, string_agg(target, ' ' ORDER BY place) AS stops FROM ch GROUP BY 1, 2 UNION ALL SELECT page_id, list_no, 2::INTEGER AS direction, string_agg(target, ' ' ORDER BY place DESC) AS stops FROM ch GROUP BY 1, 2", prelude=False)
def page_stop_orders(t: Fixtures):
    """What the lists of a page name, there and back."""
    return pages_op.orders(pages_op.choices(t.raw("pages"))).withColumn("stops", F.array_join("stops", " "))


@query("line_labels", "SELECT DISTINCT 'Bus-Linie ' || linienname AS name, linienname AS label FROM fahrten")
def line_labels(t: Fixtures):
    return t.trips.select(F.concat(F.lit("Bus-Linie "), "linienname").alias("name")).distinct().select("name", line_label(F.col("name")).alias("label"))


@query("latest_stops", "SELECT vgnkennung, haltestellenname, 2::INTEGER AS version FROM haltestellen")
def latest_stops(t: Fixtures):
    """A stop table with two appended versions of each row, read as its latest."""
    old = t.stops.select("vgnkennung", F.lower("haltestellenname").alias("haltestellenname"), F.lit(1).alias("version"))
    return latest_version(old.unionByName(t.stops.select("vgnkennung", "haltestellenname", F.lit(2).alias("version"))), ["vgnkennung"], "version")
