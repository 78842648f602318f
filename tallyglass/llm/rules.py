"""Quality rules: exact per-document counts, and a hashed n-gram log-likelihood ratio, in DataFrame operations only.

Tokens (runs of letters, runs of digits, runs of other signs) and pairs of neighbouring tokens are hashed into a fixed
number of bins.  Two multinomials over the bins are counted: one of all documents, one of trusted documents (labelled
good).  A document's verdict is the mean over its n-grams of log(p_trusted / p_raw), held against a fixed threshold.
The table of ratios has one number per bin whatever the data, so each document looks it up in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"
BINS = 1 << 15
#: Trusted ids that are broadcast at most, of 8 bytes each; more of them meet the documents by a merge join.
BROADCAST_IDS = 500_000
#: Added to every bin's count on both sides.
SMOOTHING = 1.0
#: A document below this mean log ratio is rejected.
THRESHOLD = -0.5
SPACES, SYMBOL = " \t\n\x0b\x0c\r", r"[#*$%&|<>]"
SPAN = 5


def words_in_repeats(words: Column, hashes: Column, span: int = SPAN) -> tuple[Column, Column]:
    """Columns: the hash of each window of ``span`` words, and from these (as column ``windows``) the words covered by windows that occur twice or more."""
    size = F.size(words)
    windows = F.when(
        size >= span,
        F.transform(
            F.sequence(F.lit(1), size - (span - 1)),
            lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(span))),
        ),
    )
    return size, windows


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the exact counts; a NULL text counts as empty.

    Words and windows compare by 64-bit hash.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    rows = rows.select(
        "doc_id",
        "text",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        lines.alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        "text",
        F.length(F.concat_ws("", "words")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        F.size("words").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    _, windows = words_in_repeats(F.col("hashes"), F.col("hashes"))
    rows = rows.select("doc_id", "text", "word_chars", "n_symbols", "n_words", "n_dup_lines", windows.alias("windows"))
    # only a document with a repeated window needs its windows sorted
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.when(
        repeated,
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    rows = rows.select("doc_id", "text", "word_chars", "n_symbols", "n_words", "n_dup_lines", ordered.alias("ordered"))
    twice = F.filter(
        F.col("ordered"),
        lambda x, k: (x["h"] == F.get(F.col("ordered"), k - 1)["h"]) | (x["h"] == F.get(F.col("ordered"), k + 1)["h"]),
    )
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct((s + SPAN).alias("end"), (a["n"] + s + SPAN - F.greatest(s, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words")
    )


def bins_of(text: Column) -> Column:
    """Bins of a text's tokens, and of its token pairs, as one array."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _bin(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BINS - 1)).cast("int")


def _with_bins(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("__h", bins_of(F.col("text"))).drop("text")
    pairs = F.transform(
        F.col("__h"), lambda h, i: F.struct(_bin(h).alias("one"), _bin(F.xxhash64(h, F.get(F.col("__h"), i + 1))).alias("two"))
    )
    return rows.withColumn("__bins", pairs).drop("__h")


def fit_ratio(docs: DataFrame, labels: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Stored one-row table: ``ratio``, log(p_trusted / p_raw) for each bin in order.

    The raw side counts all documents, the trusted side all that are labelled good.  Without any trusted n-gram every ratio
    is 0.
    """
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("good_id")).distinct()
    few = good.limit(broadcast_ids + 1).count() <= broadcast_ids
    good = F.broadcast(good) if few else good.hint("merge")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    flagged = rows.join(good, F.col("doc_id") == F.col("good_id"), "left").select(
        F.col("good_id").isNotNull().alias("trusted"), "text"
    )
    # Outer, as else Spark infers a filter on the array's size and works out the nested arrays again for it, word by word.
    grams = _with_bins(flagged).select("trusted", F.explode_outer("__bins").alias("g"))
    ones = grams.select("trusted", F.explode(F.array("g.one", "g.two")).alias("bin")).filter("bin is not null")
    per = ones.groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("good"))
    bins = docs.sparkSession.range(BINS).select(F.col("id").cast("int").alias("bin"))
    full = bins.join(per, "bin", "left").select("bin", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    table = full.agg(
        F.sort_array(F.collect_list(F.struct("bin", "raw", "good"))).alias("t"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good")
    )
    space = SMOOTHING * BINS
    ratio = F.transform(
        "t",
        lambda x: F.when(
            F.col("n_good") > 0,
            F.log((x["good"] + SMOOTHING) / (F.col("n_good") + space)) - F.log((x["raw"] + SMOOTHING) / (F.col("n_raw") + space)),
        ).otherwise(F.lit(0.0)),
    )
    return stored(table.select(ratio.alias("ratio")), "ratio")


def ratio_score(docs: DataFrame, ratio: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``ratio``, the mean log ratio of its n-grams (0 for a text without any)."""
    # BINS numbers, so small enough for a constant; a subquery cannot stand inside a higher-order function
    numbers = ",".join(f"{x:.4f}" for x in ratio.first()["ratio"])
    table = F.split(F.lit(numbers), ",").cast("array<double>")
    rows = _with_bins(docs)
    total = F.aggregate(
        F.col("__bins"), F.lit(0.0), lambda a, g: a + F.get(table, g["one"]) + F.get(table, g["two"])
    )
    n = F.size("__bins") * 2
    return rows.withColumn("ratio", F.when(n > 0, total / n).otherwise(F.lit(0.0))).drop("__bins")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the exact counts, whether the base rules fail, the ratio, and whether it is kept.

    An empty or NULL text has no words and fails the base rules.  Repeated rows give repeated results.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = ratio_score(base_columns(ids), fit_ratio(ids, labels))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("ratio") >= threshold)).alias("kept"),
        "ratio",
    )
