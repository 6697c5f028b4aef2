"""Rule-based quality filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import WORD, staged

SPACE = r"[\x20\x09-\x0D]+"


def sorted_windows(words: Column) -> Column:
    """Hash and place of every 3-word window, sorted, so that equal windows are neighbours."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    triples = F.arrays_zip(F.slice(words, 1, n).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    return F.sort_array(F.transform(triples, lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), i.alias("p"))))


def document_metrics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to the rows of `docs` (column text).

    A null or empty text has zeros. Windows are told apart by a 64-bit hash of their words.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    first = docs.withColumns({"_words": F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), "_lines": lines})
    second = first.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_sorted": sorted_windows(F.col("_words")),
        }
    ).drop("_words", "_lines")
    none = F.array(F.lit(None).cast("struct<h:bigint,p:int>"))
    third = second.withColumn(
        "_near", F.arrays_zip(F.col("_sorted").alias("own"), F.concat(none, F.slice("_sorted", 1, F.greatest(F.size("_sorted") - 1, F.lit(0)))).alias("last"), F.slice("_sorted", 2, F.greatest(F.size("_sorted") - 1, F.lit(0))).alias("next"))
    ).drop("_sorted")
    same = lambda x, k: F.coalesce(x["own"]["h"] == x[k]["h"], F.lit(False))
    fourth = third.withColumn("_at", F.sort_array(F.transform(F.filter("_near", lambda x: same(x, "last") | same(x, "next")), lambda x: x["own"]["p"]))).drop("_near")
    steps = F.arrays_zip(F.col("_at").alias("own"), F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))).alias("next"))
    return fourth.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + F.least(F.lit(3), F.coalesce(x["next"] - x["own"], F.lit(3))))).drop("_at")


def normalised_line(line: Column) -> Column:
    """Lower case, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_facts(host: Column) -> Column:
    """For each line with a word: key (host and normalised line, hashed) and length."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(WORD))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(host, normalised_line(x)).alias("line_key"), F.length(x).alias("n")))


def common_lines(measured: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """Line keys that at least `min_docs` distinct documents of one host hold, and at least `min_share` of its documents.

    `measured` has host, document (a number of the document) and facts (`line_facts`). Copies are documents like others.
    """
    documents = measured.select("host", "document").distinct().groupBy("host").agg(F.count("*").alias("in_host"))
    seen = measured.select("host", "document", F.explode(F.array_distinct("facts.line_key")).alias("line_key")).distinct()
    counts = seen.groupBy("host", "line_key").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return counts.join(documents, "host").filter(F.col("n_docs") >= min_share * F.col("in_host")).select("line_key", "n_docs")


def without_lines(text: Column, host: Column, keys: Column) -> Column:
    """`text` without its lines of those keys; lines without a word stay, null is empty."""
    whole = F.coalesce(text, F.lit(""))
    rest = F.filter(F.split(whole, "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains(keys, F.xxhash64(host, normalised_line(x)))))
    return F.when(keys.isNull(), whole).otherwise(F.array_join(rest, "\n"))


def quality_filter(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeat_pct: int = 50, min_docs: int = 20, min_share: float = 0.002, max_lost_share: float = 0.5, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, the metrics of `document_metrics`, base_failed, n_common_chars, kept.

    base_failed: fewer than `min_words` words, or more than `max_repeat_pct` % of the words in repeated 3-word windows.
    Lines that `common_lines` finds are removed, and with `keep_text` the rest is in `kept_text`, for documents that are
    not kept too; a document that loses more than `max_lost_share` of its characters in lines with a word is depleted and
    not kept. Null hosts form one host; null texts have no lines and fail the base rule. Rows that repeat a doc_id are one
    document where documents are counted, and are judged each for itself; a row without doc_id is a document of its own.
    """
    owner = F.coalesce(F.col(host).cast("string"), F.lit(""))
    rows = docs.select("doc_id", "text", owner.alias("host"), line_facts(owner).alias("facts"))
    found = document_metrics(rows)
    numbered = (found if keep_text else found.drop("text")).withColumn("row", F.monotonically_increasing_id())
    document = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64(F.lit("row"), "row"))
    measured = staged(numbered.withColumn("document", document), "quality")
    common = staged(common_lines(measured, min_docs, min_share), "common_lines").select("line_key")
    hit = measured.select("row", F.inline("facts")).join(common, "line_key", "left_semi")
    lost = hit.groupBy("row").agg(F.sum("n").alias("lost"), *([F.collect_set("line_key").alias("keys")] if keep_text else []))
    in_lines = F.aggregate("facts.n", F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    judged = (
        measured.select("doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", in_lines.alias("in_lines"), *(["text", "host"] if keep_text else []))
        .join(lost, "row", "left")
        .withColumns({"base_failed": failed, "n_common_chars": F.coalesce("lost", F.lit(0).cast("long"))})
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_common_chars") <= max_lost_share * F.col("in_lines")))
        .drop("row", "lost", "in_lines")
    )
    return judged.withColumn("kept_text", without_lines(F.col("text"), F.col("host"), F.col("keys"))).drop("text", "host", "keys") if keep_text else judged
