"""Mixing sources to target weights, in DataFrame operations only.

Each source's words are packed into blocks of ``block_words``.  Sources get as many of the mix's slots as their target
needs; every slot goes through a pseudorandom permutation of all slots to its place in an output shard, so a shard's
source counts are a multinomial draw, conditioned on the totals: unconditioned draws would miss a small source's target by
the square root of its slots and could pass the cap.  A source's slots in turn go through a permutation of its block
numbers, a new one for each round over its blocks, and blocks are joined by (source, number).  The mix is written by
(shard, position), one partition per shard.

The permutations are arithmetic on 64-bit integers (rotations of rows by a hashed amount, and multiplication by a prime
modulo the size), so reruns agree and no row has to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 64
#: Words of a block for texts that are packed afterwards: some 700 tokens, so that a window holds few pieces.
TEXT_BLOCK_WORDS = 256
SHARD_SLOTS = 4096
SLOTS_PER_TASK = 100_000
#: Ids in a run, and runs in a group, for running sums in three levels.
RUN, GROUP = 128, 2048
_PRIMES = (4194301, 4194287)  # below 2^22, so products with sizes up to 2^40 fit in 64 bits


def permuted(df: DataFrame, name: str, i: Column, n: Column, key: Column) -> DataFrame:
    """``df`` with ``name``, the place of ``i`` in a pseudorandom permutation of 0 .. n-1; ``key`` picks it; n up to 2^40.

    Steps are columns of their own, so that each is evaluated once.
    """
    kept = df.columns
    prime = F.when(n % _PRIMES[0] == 0, F.lit(_PRIMES[1])).otherwise(F.lit(_PRIMES[0])).cast("bigint")
    df = df.select("*", i.alias("__x"), n.alias("__n"), key.cast("bigint").alias("__k"), prime.alias("__p"))
    for turn, width in enumerate((1021, 61, 4093)):
        # rows of `width`, the last one shorter: each rotated by an amount hashed from its number
        df = df.withColumn("__row", F.expr(f"__x div {width}"))
        length = F.least(F.lit(width).cast("bigint"), F.col("__n") - F.col("__row") * width)
        moved = F.pmod(F.xxhash64("__row", "__k", F.lit(turn)), length) + F.col("__x") % width
        df = df.withColumn("__x", F.col("__row") * width + moved % length)
        df = df.withColumn("__x", (F.col("__x") * F.col("__p") + F.col("__k") * 613 + turn) % F.col("__n"))
    return df.select(*kept, F.col("__x").alias(name))


def word_sizes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """Stored (row, doc_id, source, skey, size); ``skey`` tells a NULL source from an empty one."""
    rows = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("skey"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    return stored(rows, "sizes")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: size, target, blocks and slots.

    Targets share the total size by weight and stop at ``repeats`` times a source's size; the excess goes to the others by
    weight.  In order of cap by weight, the first source whose share is no more than its cap ends the capped ones, and
    its share per weight holds for all after it.
    """
    per = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(by_name) - 1).cast("bigint")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.select("*", number.alias("source_no")).select("*", weight.alias("weight"))
    cap = F.col("source_size") * repeats
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    fits = F.col("left") * F.col("weight") <= cap * F.col("left_weight")
    share = F.when(fits, F.col("left").cast("double") / F.col("left_weight"))
    level = F.first(share, ignorenulls=True).over(everything)
    target = F.coalesce(F.least(cap.cast("double"), level * F.col("weight")), cap.cast("double"))
    return per.select("*", target.alias("target"))


def with_slots(per: DataFrame, block_words: int) -> DataFrame:
    """``per`` with its blocks, slots, and the slots of the sources before it."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    per = per.select("*", blocks.alias("blocks"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"))
    per = per.select("*", F.coalesce(slots, F.lit(0)).alias("slots"))
    everything = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        "*",
        F.coalesce(F.sum("slots").over(before), F.lit(0)).alias("slots_before"),
        F.sum("slots").over(everything).alias("all_slots"),
    )


def stream_starts(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``begin``, the words of its source before the row, in order of (doc_id, size).

    Running sums in three levels (ids of a run, runs of a group, groups), so that no task sorts a whole source.
    """
    lowest = F.lit(-(2**62))
    run = F.coalesce(F.floor(F.col("doc_id") / RUN).cast("bigint"), lowest)
    rows = sizes.select("*", run.alias("run"), F.floor(run / GROUP).cast("bigint").alias("grp"))

    def sums_before(df: DataFrame, value: str, over: list[str], order: list[str], name: str) -> DataFrame:
        window = Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))

    runs = rows.groupBy("skey", "grp", "run").agg(F.sum("size").alias("run_size"))
    groups = runs.groupBy("skey", "grp").agg(F.sum("run_size").alias("grp_size"))
    groups = sums_before(groups, "grp_size", ["skey"], ["grp"], "in_groups").drop("grp_size")
    runs = sums_before(runs, "run_size", ["skey", "grp"], ["run"], "in_runs").drop("run_size")
    rows = sums_before(rows, "size", ["skey", "run"], ["doc_id", "size", "row"], "in_rows")
    placed = rows.join(runs.join(groups, ["skey", "grp"]), ["skey", "grp", "run"])
    begin = F.col("in_rows") + F.col("in_runs") + F.col("in_groups")
    return placed.select("row", "doc_id", "source", "skey", "size", begin.alias("begin"))


def slot_table(per: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: (skey, block, shard, place in the shard).

    A source's slots are made in stretches that are dealt out first, so a hot source is spread.
    """
    stretch = 4096
    total = per.agg(F.max("all_slots")).first()[0] or 0
    stretches = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / stretch).cast("bigint"))
    dealt = (
        per.filter("slots > 0")
        .select("skey", "source_no", "blocks", "slots", "slots_before", "all_slots", F.explode(stretches).alias("stretch"))
        # A number of its own, as by the size of these few rows Spark would put them all in one task.
        .repartition(max(1, -(-total // SLOTS_PER_TASK)), "skey", "stretch")
    )
    first = F.col("stretch") * stretch
    last = F.least(first + stretch, F.col("slots")) - 1
    slots = dealt.select("*", F.explode(F.sequence(first, last)).alias("slot"))
    slots = permuted(slots, "place", F.col("slots_before") + F.col("slot"), F.col("all_slots"), F.lit(17))
    turn = F.expr("slot div blocks")
    slots = permuted(slots, "block", F.col("slot") % F.col("blocks"), F.col("blocks"), (F.col("source_no") % 1000) * 8 + turn + 1)
    return slots.select(
        "skey", "block", F.expr(f"place div {shard_slots}").alias("shard"), (F.col("place") % shard_slots).alias("position")
    )


def shard_counts(slots: DataFrame) -> DataFrame:
    """Slots per shard and source: the counts drawn for each output shard."""
    return slots.groupBy("shard", "skey").agg(F.count(F.lit(1)).alias("slots"))


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """(row, skey, block, at, start, words): a document's words in each block it touches.

    ``at`` is their place in the block, and ``start`` the first one's number in the document.
    """
    touched = F.sequence(
        F.floor(F.col("begin") / block_words).cast("bigint"), F.floor((F.col("begin") + F.col("size") - 1) / block_words).cast("bigint")
    )
    rows = placed.filter("size > 0").select("row", "skey", "size", "begin", F.explode(touched).alias("block"))
    start = F.greatest(F.col("begin"), F.col("block") * block_words)
    end = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.select(
        "row", "skey", "block", (start - F.col("block") * block_words).cast("int").alias("at"), (start - F.col("begin")).cast("int").alias("start"),
        (end - start).cast("int").alias("words"),
    )


def mix_plan(docs: DataFrame, block_words: int = BLOCK_WORDS, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their source's figures, the stored rows of the mix, and the slot table.

    A row of the mix is what one document gives to the block in one slot: (shard, position, at, row, start, words).
    """
    sizes = word_sizes(docs, row)
    per = stored(with_slots(source_targets(sizes), block_words), "targets")
    slots = slot_table(per)
    # Merged, here and below: Spark takes exploded rows for as few as they came from, and would copy them to every executor.
    mixed = _pieces(stream_starts(sizes), block_words).join(slots.hint("merge"), ["skey", "block"])
    mixed = stored(mixed.select("shard", "position", "at", "row", "start", "words"), "mixed")
    rows = sizes.join(per.select("skey", "source_size", "target"), "skey")
    return rows, mixed, slots


def mix_report(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: its size, its source's size and target, and how many of its words the mix's rows take.

    A NULL or empty text has size 0 and is taken 0 times; a NULL source is a source of its own, after all others.
    Repeated rows lie one after the other in their source's stream.
    """
    rows, mixed, _ = mix_plan(docs, block_words)
    taken = mixed.groupBy("row").agg(F.sum(F.col("words").cast("bigint")).alias("taken"))
    return rows.join(taken.hint("merge"), "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "source"
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, from_files: bool = False) -> DataFrame:
    """The mix, with the columns of ``docs``, one partition per output shard and in order of position.

    A row is the words of a document in one slot's block, with the white space before each word and after the last one of
    the document.  Documents without words, and those that no slot takes, are left out.

    A row is known by a number, for which ``docs`` is stored first.  With ``from_files``, ``docs`` is a plain read of files
    (no join, union or explode after it), whose rows are known by their file and place in it, and no copy is stored.
    """
    # the documents' columns travel inside one struct, so none clashes with a name used here
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.lit(0).alias("text")).alias("held")
    if from_files:
        number = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        numbered = docs.select(number.alias("number"), "doc_id", "text", "source", held)
    else:
        numbered = stored(docs.select(F.monotonically_increasing_id().alias("number"), "doc_id", "text", "source", held), "to-mix")
    _, mixed, _ = mix_plan(numbered, block_words, F.col("number"))
    shards = (mixed.agg(F.max("shard")).first()[0] or 0) + 1
    # Of one document: three times its blocks at most, so as long as its text.
    places = mixed.groupBy(F.col("row").alias("number")).agg(
        F.collect_list(F.struct("shard", "position", "at", "start", "words")).alias("places")
    )
    space = r"[\x20\x09-\x0D]"
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"{space}*{WORD}(?:{space}+\z)?"), F.lit(0))
    joined = numbered.join(places.hint("merge"), "number").withColumn("words", words)
    piece = lambda p: F.struct(
        p["shard"].alias("shard"), p["position"].alias("position"), p["at"].alias("at"),
        F.array_join(F.slice(F.col("words"), p["start"] + 1, p["words"]), "").alias("text"),
    )
    # words is named twice, as Spark would else move its expression into the lambda and split the text again for each piece
    pieces = F.when(F.size("words") > 0, F.transform("places", piece))
    cut = joined.select("held", pieces.alias("pieces")).select("held", F.explode("pieces").alias("piece"))
    dealt = cut.repartitionById(shards, F.col("piece.shard").cast("int")).sortWithinPartitions("piece.shard", "piece.position", "piece.at")
    text = F.col("piece.text")
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return dealt.select(*((columns[c] if c in columns else F.col("held").getField(c)).alias(c) for c in docs.columns))
