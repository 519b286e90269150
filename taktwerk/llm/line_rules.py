"""Quality rules from cross-document line frequency, as DataFrame operations only.

Lines are normalised (white space collapsed, lower case) and hashed; for each host the distinct documents that hold
a line are counted, copies of one text each for itself (without ``count_copies`` as one document); lines above the
limit are removed, and a document that keeps too small a part of its words is rejected.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own, apart from the empty one; repeated rows
are one document, as are rows without a key that share a host and a text; copies get the same verdict; lines without a word count nowhere; an empty table gives an empty table; columns
other than the key, the text and the host are not read. Exact for texts of any length; lines and word triples are
compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taktwerk.llm import common

#: A line is removed that more distinct documents of its host hold.
MAX_DOCS = 10
#: A document is rejected that keeps a smaller part of its words.
MIN_LEFT = 0.3
BASE_MIN_WORDS, BASE_MAX_REPEAT_PERCENT = 50, 50
SPACE = r"[\x20\x09-\x0D]+"
SALTS = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def base_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Counts in single texts: key, host, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Triples of words are hashed in place; only where a triple occurs twice are they sorted with their positions.
    """
    t = F.col("text_")
    df = docs.select(F.col(key).alias(key), common.told_apart(F.col(host)).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    df = df.select(
        key, "host", F.xxhash64(t).alias("text_key"), words_of(t).alias("w"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    df = df.select(
        key, "host", "text_key", "n_symbols", F.size("w").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.when(F.size("w") > 3, F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).alias("h"),
    )
    df = df.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    df = df.withColumn("p", F.array_sort(F.filter(F.transform("s", lambda x, j: F.when(F.coalesce(x["h"] == F.get("s", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("s", j + 1)["h"], F.lit(False)), x["i"]).otherwise(-1)), lambda i: i >= 0)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("p", lambda i, j: F.least(F.lit(3), i - F.coalesce(F.get("p", j - 1), i - 3))), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select(key, "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def normalised(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, SPACE, " ")))


def line_counts(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, text_key, line_key, words): a row for each distinct line of a text, with its words over all its places."""
    df = docs.where(F.col(text).isNotNull()).select(common.told_apart(F.col(host)).alias("host"), F.xxhash64(text).alias("text_key"), F.explode(F.split(text, "\n")).alias("line"))
    df = df.select("host", "text_key", normalised(F.col("line")).alias("line")).where("line <> ''")
    df = df.select("host", "text_key", F.xxhash64("line").alias("line_key"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("bigint").alias("words"))
    return df.groupBy("host", "text_key", "line_key").agg(F.sum("words").alias("words"))


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(host, text_key, copies): how many documents of a host have a text; repeated rows are one document."""
    rows = docs.where(F.col(text).isNotNull()).select(common.told_apart(F.col(host)).alias("host"), F.xxhash64(text).alias("text_key"), F.col(key).alias("key_"))
    return rows.distinct().groupBy("host", "text_key").agg(F.count("*").alias("copies"))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line_key) of lines that more than ``max_docs`` distinct texts of a host hold, or documents where ``lines``
    tells how many ``copies`` a text has; counts are summed before the shuffle."""
    each = F.sum("copies") if "copies" in lines.columns else F.count("*")
    return lines.groupBy("host", "line_key").agg(each.alias("n_docs")).where(F.col("n_docs") > max_docs).drop("n_docs")


def removed_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of ``lines`` whose line goes. Frequent lines are few and dealt in copies, so that no line gathers its documents in one task."""
    few = frequent_lines(lines, max_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int")).join(few, ["host", "line_key", "salt"]).drop("salt")


def depleted(lines: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """(host, text_key) of texts that keep less than ``min_left`` of their words."""
    lost = removed_lines(lines, max_docs).select("host", "text_key", F.lit(0).cast("bigint").alias("words"), F.col("words").alias("lost"))
    both = lines.select("host", "text_key", "words", F.lit(0).cast("bigint").alias("lost")).unionByName(lost)
    sums = both.groupBy("host", "text_key").agg(F.sum("words").alias("words"), F.sum("lost").alias("lost"))
    return sums.where((F.col("words") - F.col("lost")) < F.lit(min_left) * F.col("words")).select("host", "text_key")


def counted_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", count_copies: bool = True) -> DataFrame:
    """``line_counts``, with how many documents have the text unless copies are one document; stored."""
    lines = line_counts(docs, text, host)
    if count_copies:
        lines = lines.join(text_counts(docs, key, text, host), ["host", "text_key"])
    return common.save(lines, "lines")


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, key: str = "doc_id", text: str = "text", host: str = "source", count_copies: bool = True) -> DataFrame:
    """The documents with their frequent lines taken out of the text; all columns stay."""
    lines = counted_lines(docs, key, text, host, count_copies)
    gone = removed_lines(lines, max_docs).groupBy("host", "text_key").agg(F.collect_set("line_key").alias("gone_"))
    gone = gone.select(F.col("host").alias("host_"), F.col("text_key").alias("text_key_"), "gone_")
    left = docs.join(gone, (common.told_apart(docs[host]) == gone["host_"]) & (F.xxhash64(docs[text]) == gone["text_key_"]), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains("gone_", F.xxhash64(normalised(x)))), "\n")
    return left.withColumn(text, F.when(F.col("gone_").isNull(), F.col(text)).otherwise(kept)).drop("host_", "text_key_", "gone_")


def verdicts(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, key: str = "doc_id", text: str = "text", host: str = "source", count_copies: bool = True) -> DataFrame:
    """The base counts of each document and ``kept``: it passed the base rules and is not depleted."""
    lines = counted_lines(docs, key, text, host, count_copies)
    out = depleted(lines, max_docs, min_left).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("gone", F.lit(True))
    base = base_rules(docs, key, text, host).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    joined = base.join(out, ["host", "text_key", "salt"], "left")
    return joined.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("gone").isNull()).alias("kept"))
