"""SimHash fingerprints, likeness, and search within a Hamming radius by permuted block tables.

Terms are words and pairs of neighbouring words; a term's hash votes for or against each bit with the term's weight, and
the signs of the sums are the fingerprint.  Bits of two texts agree with probability 1 - angle / pi, so the cosine of the
disagreeing share times pi estimates how alike their weighted terms are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import id_and_text

BITS = 128
WORD_WEIGHT, PAIR_WEIGHT = 0.35, 1.0
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Fingerprints of texts; remembers the hashes of a bounded number of words."""

    def __init__(self, remembered: int = 300_000):
        self.remembered = remembered
        self.known: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))

    def __call__(self, text: str) -> bytes:
        """The fingerprint; words are the runs without white space of the text, ASCII letters in lower case."""
        words = text.encode().lower().split()
        h = self._hashes(words)
        terms, counts = np.unique(np.concatenate([_mixed(h), _mixed(h[:-1] * _M1 + h[1:])]), return_counts=True)
        singles = np.isin(terms, _mixed(h), assume_unique=False) if len(h) else np.zeros(0, bool)
        weights = (1 + np.log(counts)) * np.where(singles, WORD_WEIGHT, PAIR_WEIGHT)
        wide = np.stack([terms, _mixed(terms + _M1)], 1)
        votes = np.zeros(BITS)
        for at in range(0, len(terms), 4096):
            bits = np.unpackbits(wide[at : at + 4096].view("u1").reshape(-1, BITS // 8), axis=1)
            votes += weights[at : at + 4096].astype("f4") @ bits.astype("f4") - weights[at : at + 4096].sum() / 2
        return np.packbits(votes > 0).tobytes()


def distance(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()


def likeness(a: bytes, b: bytes) -> float:
    return float(max(0.0, np.cos(np.pi * distance(a, b) / BITS)))


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _in_order(docs: DataFrame) -> DataFrame:
    """Documents dealt to tasks in runs of descending id, each run followed by the first document of the next.

    Bounds come from quantiles of the ids.  Rows of one id are in order of their text; a NULL id comes last.  The column
    ``extra`` marks the document that is there only to be the next one.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted({int(b) for b in bounds})
    run = F.lit(len(bounds))
    if bounds:
        # runs are numbered from the largest ids on
        below = F.expr("size(filter(array(" + ",".join(f"{b}L" if b >= 0 else f"cast({b} as bigint)" for b in bounds) + "), b -> b >= doc_id))")
        run = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(below)
    rows = docs.withColumn("run", run.cast("bigint"))
    tie = F.xxhash64("text")
    # one row per run
    firsts = rows.groupBy("run").agg(F.max(F.struct("doc_id", tie.alias("tie"))).alias("first"))
    around = Window.orderBy("run")
    everything = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(
        "run", "first", F.coalesce(F.lag("run").over(around), F.last("run").over(everything)).alias("run_before")
    )
    rows = rows.join(F.broadcast(firsts), "run")
    is_first = F.struct("doc_id", tie.alias("tie")).eqNullSafe(F.col("first"))
    places = F.array_compact(
        F.array(
            F.struct(F.col("run").alias("run"), F.lit(False).alias("extra")),
            F.when(is_first, F.struct(F.col("run_before").alias("run"), F.lit(True).alias("extra"))),
        )
    )
    return rows.select("doc_id", "text", F.explode(places).alias("p")).select("p.run", "p.extra", "doc_id", "text")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row per document, with the fingerprints of its text and of its edited text.

    The next document is the one with the next lower id, after the last the first.  Equal ids are in order of a hash of
    their text, of which copies are alike; NULL ids come last; a NULL text is empty.
    """
    placed = _in_order(id_and_text(docs))
    # negative numbers of id, so that a plain ascending sort gives descending ids with the extra row at the end
    dealt = placed.repartition("run").sortWithinPartitions(
        F.col("run"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()
    )
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held = None  # (run, id, text, fingerprint) that waits for its next document
        out: list[tuple] = []
        last_run_done = None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for number, extra, doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if extra and number == last_run_done:
                        continue  # further copies of the first document
                    print_ = hasher(text)
                    if held is not None and held[0] == number:
                        changed = edited(held[2], text)
                        changed_print = hasher(changed)
                        out.append(
                            (
                                held[1],
                                len(held[2]),
                                hashlib.sha256(changed.encode()).hexdigest(),
                                held[3].hex(),
                                changed_print.hex(),
                                likeness(held[3], changed_print),
                                likeness(held[3], print_),
                            )
                        )
                    last_run_done = number if extra else None
                    held = None if extra else (number, doc_id, text, print_)
                if out:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip([f.split()[0] for f in schema.split(", ")], row, strict=True)) for row in out], schema=arrow
                    )
                    out = []

    from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415
    from pyspark.sql.types import StructType  # noqa: PLC0415

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(run, schema)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as hexadecimal) of every document."""
    from tallyglass.llm.common import map_texts  # noqa: PLC0415

    def each(ids: list, texts: list) -> dict[str, list]:
        hasher = Hasher()
        return {"doc_id": ids, "fingerprint": [hasher(t).hex() for t in texts]}

    return map_texts(id_and_text(docs), each, "doc_id bigint, fingerprint string")


def within_radius(queries: DataFrame, prints: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """Pairs (query, found, distance): all fingerprints at most ``radius`` bits from each query's.

    The bits are cut into blocks; two fingerprints within the radius agree in all but ``radius`` of them.  Each choice of
    ``blocks - radius`` blocks is a table keyed by those blocks' bits.  Equal fingerprints are looked up once.
    """
    blocks = blocks or radius + 2
    edges = [BITS // 4 * i // blocks for i in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))

    def key(chosen: tuple[int, ...]):
        return F.concat(*(F.substring("fingerprint", edges[i] + 1, edges[i + 1] - edges[i]) for i in chosen))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select("fingerprint").distinct()
        return distinct.select(F.col("fingerprint").alias(name), F.posexplode(F.array(*map(key, tables))).alias("t", "key"))

    pairs = keyed(queries, "query").join(keyed(prints, "found"), ["t", "key"])
    parts = [
        F.bit_count(F.conv(F.substring("query", i, 8), 16, 10).cast("bigint").bitwiseXOR(F.conv(F.substring("found", i, 8), 16, 10).cast("bigint")))
        for i in range(1, BITS // 4 + 1, 8)
    ]
    far = parts[0]
    for p in parts[1:]:
        far = far + p
    return pairs.select("query", "found", far.cast("int").alias("distance")).filter(F.col("distance") <= radius).distinct()
