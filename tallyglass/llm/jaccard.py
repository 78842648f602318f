"""N-gram Jaccard join: banded MinHash candidates, Bayesian pruning, exact verification, classes of linked documents.

1.  Every document gets the MinHash values of its word 5-grams.  Documents with equal texts are one class member from here
    on.
2.  Members that share a band of values meet in a unit; a large unit is cut into blocks, and each pair of blocks is a unit
    of its own, so no task holds a whole group.  A pair is looked at in the first band it shares only.
3.  Its values are compared a few at a time.  With m agreements in n values the similarity has a Beta posterior; as soon as
    the chance of reaching the threshold is below the tolerance the pair is dropped.
4.  What is left is verified on the 5-grams themselves.  A unit gives back each member's number of links and a forest of
    links that joins the same members, so its output does not grow with its pairs.
5.  Classes are the connected components of the forests.

With 32 bands of 4 values, a pair at the threshold shares no band with probability 5e-8, and less above it; the pruning
loses a true pair with at most the tolerance's probability at each look.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import id_and_text, stored

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
#: Values compared between two looks at the posterior, and the chance below which a pair is dropped.
LOOK, TOLERANCE = 16, 1e-6
#: Members of a block of a large unit.
BLOCK = 2048
SEED = 20240503

_rng = np.random.default_rng(SEED)
_A = (_rng.integers(0, 1 << 32, VALUES, dtype="u8") | 1).astype("u4")
_B = _rng.integers(0, 1 << 32, VALUES, dtype="u8").astype("u4")


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` words of a lower-cased (A-Z) text, sorted.

    A text of fewer words is one run; a text without words has none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    if len(words) <= size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], "u8")
    names = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(names.__getitem__, words), "u8", len(words))
    total = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(29)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype("u4")
    best = np.full(VALUES, 0xFFFFFFFF, "u4")
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048]
        np.minimum(best, (part[None, :] * _A[:, None] + _B[:, None]).min(1), out=best)
    return ((best * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2")


@lru_cache(maxsize=4)
def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest agreements that keep a pair), from the Beta(m + 1, n - m + 1) posterior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(LOOK, VALUES + 1, LOOK):
        for m in range(n + 1):
            log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(grid) + (n - m) * np.log1p(-grid)
            if np.exp(log[grid >= threshold]).sum() / 20_000 >= tolerance:
                out.append((n, m))
                break
    return tuple(out)


def sketch_table(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, member, values): ``member`` is the md5 of the text; ``values`` is NULL for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes = [shingles(t) for t in part.column(2).to_pylist()]
                values = [signature(h).tobytes() if len(h) else None for h in hashes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, pa.binary())], names=["doc_id", "member", "values"])

    rows = id_and_text(docs).select("doc_id", F.unhex(F.md5("text")).alias("member"), "text")
    return stored(rows.mapInArrow(run, "doc_id bigint, member binary, values binary"), "sketches")


def member_table(sketches: DataFrame) -> DataFrame:
    """Stored (member, values, rep, copies): one row per distinct text; copies are first put together in each partition."""
    return stored(
        sketches.groupBy("member").agg(
            F.first("values").alias("values"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")
        ),
        "members",
    )


def _unit_rows(members: DataFrame) -> DataFrame:
    """Rows (unit, side, band, member, values, copies) of the units of two members or more, dealt by unit."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, BANDS, ROWS)
                key = np.ascontiguousarray(values).view("<u8").reshape(-1, BANDS)
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype="u8")
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view("i8").ravel()),
                        pa.array(np.tile(np.arange(BANDS, dtype="i4"), n)),
                        part.column(0).take(pa.array(np.repeat(np.arange(n), BANDS))),
                    ],
                    names=["key", "band", "member"],
                )

    known = members.filter("values is not null")
    keyed = known.select("member", "values").mapInArrow(keys, "key bigint, band int, member binary")
    keyed = stored(keyed, "bands")
    sizes = keyed.groupBy("key", "band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = keyed.join(sizes, ["key", "band"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("bigint")
    own = F.pmod(F.xxhash64("member"), F.col("blocks"))
    met = met.withColumn("blocks", blocks).withColumn("own", own)
    # a block meets itself and every other: with itself all are of one side
    met = met.select("key", "band", "member", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    met = met.select(
        F.xxhash64("key", "band", F.least("own", "other"), F.greatest("own", "other")).alias("unit"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"),
        "band",
        "member",
    )
    return met.join(known.select("member", "values", "copies"), "member").select("unit", "side", "band", "member", "values", "copies")


def _units(batches: Iterator[pa.RecordBatch], many: int = 4096) -> Iterator[pa.Table]:
    """Whole units of a sorted partition, several at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= many:
            table = pa.Table.from_batches(held).combine_chunks()
            unit = table.column("unit").to_numpy()
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _pruned(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one unit that share no earlier band and survive the looks at their values."""
    unit, side, band = (table.column(c).to_numpy() for c in ("unit", "side", "band"))
    values = np.frombuffer(b"".join(table.column("values").to_pylist()), "<u2").reshape(-1, VALUES)
    bands = np.ascontiguousarray(values).view("<u8").reshape(-1, BANDS)
    looks = least_agreements()
    left, right = [], []
    rows = np.arange(len(unit) - 1)
    apart = 1
    while len(rows):
        rows = rows[rows + apart < len(unit)]
        rows = rows[unit[rows] == unit[rows + apart]]
        a = rows[(side[rows] == 0) | (side[rows] != side[rows + apart])]
        for b in range(BANDS - 1):
            a = a[(band[a] <= b) | (bands[a, b] != bands[a + apart, b])]
        agree = np.zeros(len(a), "i8")
        for n, least in looks:
            agree += (values[a, n - LOOK : n] == values[a + apart, n - LOOK : n]).sum(1)
            keep = agree >= least
            a, agree = a[keep], agree[keep]
        left.append(a)
        right.append(a + apart)
        apart += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def candidate_units(members: DataFrame) -> DataFrame:
    """Stored (unit, place, member, copies, pairs): members with a surviving pair, by unit; ``pairs`` has the places of the later members that the member is paired with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            left, right = _pruned(table)
            if not len(left):
                continue
            used = np.unique(np.concatenate([left, right]))
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            begin, end = np.searchsorted(left, used), np.searchsorted(left, used, "right")
            part = table.take(pa.array(used))
            for at in range(0, len(used), 2000):
                rows = part.slice(at, 2000).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("unit").combine_chunks(),
                        pa.array(used[at : at + 2000]),
                        rows.column("member").combine_chunks(),
                        rows.column("copies").combine_chunks(),
                        pa.array([right[b:e].astype("<i4").tobytes() for b, e in zip(begin[at : at + 2000], end[at : at + 2000], strict=True)], pa.binary()),
                    ],
                    names=["unit", "place", "member", "copies", "pairs"],
                )

    rows = _unit_rows(members).repartition("unit").sortWithinPartitions("unit", "member", "side")
    return stored(rows.mapInArrow(run, "unit bigint, place bigint, member binary, copies bigint, pairs binary"), "candidates")


def _verified(places: list[int], pairs: list[bytes], sets: list[np.ndarray], threshold: float) -> list[tuple[int, np.ndarray]]:
    """For each member of a unit, the later ones whose Jaccard similarity reaches the threshold."""
    at = {p: i for i, p in enumerate(places)}
    sizes = np.array([len(s) for s in sets])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    numbers = np.split(number, ends[:-1])
    mark = np.zeros(int(number.max(initial=0)) + 1, bool)
    out = []
    for i, blob in enumerate(pairs):
        partners = np.array([at[p] for p in np.frombuffer(blob, "<i4").tolist()], "i8")
        if not len(partners):
            continue
        mark[numbers[i]] = True
        both = np.array([np.count_nonzero(mark[numbers[j]]) for j in partners])
        mark[numbers[i]] = False
        # the exact fraction, so that a pair just at the threshold counts
        linked = partners[both >= threshold * (sizes[i] + sizes[partners] - both) - 1e-9]
        if len(linked):
            out.append((i, linked))
    return out


def verified_links(docs: DataFrame, candidates: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Stored rows (a, b, links): b NULL: a has that many links to other documents' texts; else a and b are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch | None:
            rows.sort(key=lambda r: r[1])
            links = _verified([r[1] for r in rows], [r[4] for r in rows], [r[5] for r in rows], threshold)
            count, root = [0] * len(rows), list(range(len(rows)))

            def top(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            out = []
            for i, linked in links:
                for j in linked.tolist():
                    count[i] += rows[j][3]
                    count[j] += rows[i][3]
                    a, b = top(i), top(j)
                    if a != b:
                        root[b] = a
                        out.append((rows[i][2], rows[j][2], None))
            out += [(rows[i][2], None, n) for i, n in enumerate(count) if n]
            if not out:
                return None
            a, b, n = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["a", "b", "links"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for unit, place, member, copies, pairs, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if rows and unit != key:
                        if (found := done()) is not None:
                            yield found
                        rows = []
                    key = unit
                    if not rows or rows[-1][1] != place:  # a repeated row has its text once more
                        rows.append((unit, place, member, copies, pairs, shingles(text)))
        if rows and (found := done()) is not None:
            yield found

    wanted = candidates.join(members.select("member", "rep"), "member").select(
        "unit", "place", "member", "copies", "pairs", F.coalesce("rep", F.lit(-(2**63))).alias("rep")
    )
    texts = id_and_text(docs).select(
        F.unhex(F.md5("text")).alias("member"), F.coalesce("doc_id", F.lit(-(2**63))).alias("rep"), "text"
    )
    rows = wanted.join(texts, ["member", "rep"]).select("unit", "place", "member", "copies", "pairs", "text")
    dealt = rows.repartition("unit").sortWithinPartitions("unit", "place")
    return stored(dealt.mapInArrow(run, "a binary, b binary, links bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for the nodes of (a, b).

    Each round points every node's neighbours at the smallest of them, first for larger, then for smaller neighbours, until
    the edges stay the same; rounds are written to the shared folder.  The number of rounds grows with the logarithm of a
    component's size.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    digest = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == digest:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        digest = now


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, class_size).

    ``class_id`` is the smallest id in the document's class, ``n_links`` the number of other documents whose texts are equal
    or at least ``threshold`` similar.  A text without words is linked to its equals only; NULL counts as empty.
    """
    sketches = sketch_table(docs)
    members = member_table(sketches)
    links = verified_links(docs, candidate_units(members), members, threshold)
    roots = components(links.filter("b is not null"))
    counts = links.filter("b is null").groupBy(F.col("a").alias("member")).agg(F.sum("links").alias("links"))
    placed = members.select("member", "rep", "copies").join(counts, "member", "left").join(
        roots.select(F.col("node").alias("member"), "root"), "member", "left"
    )
    placed = placed.withColumn("root", F.coalesce("root", "member"))
    classes = placed.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    placed = placed.join(classes, "root").select(
        "member", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_size"
    )
    return sketches.select("doc_id", "member").join(placed, "member").select("doc_id", "class_id", "n_links", "class_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id; of repeated rows with that id and text, one."""
    # the documents' columns travel inside one struct, so none clashes with a name used here
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = F.struct(F.lit(0).alias("text"), *[F.col(f"`{c}`") for c in others]).alias("held")
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", held), "numbered")
    found = near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), threshold)
    found = found.select(F.col("doc_id").alias("row"), F.col("class_id").alias("class"))
    ids = numbered.select("row", "doc_id")
    best = found.join(ids, "row").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    kept = numbered.join(best.select("row"), "row", "left_semi")
    return kept.select(*[F.col(c) if c in ("doc_id", "text") else F.col("held").getField(c).alias(c) for c in docs.columns])
