"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Each text becomes a short vector of statistics.  Random Fourier features approximate a Gaussian kernel over them; the
partitions' sums of the normal equations give ridge scores.  Two folds are summed apart, so that each training row also
has a score from a fit without its fold: isotonic regression on those turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import DOCS_PER_CALL, id_and_text, id_remainder, map_texts, stored

HELD_OUT = (4, 2)  # modulus and remainder of the rows never learned from
CUTOFF = 0.7
N_FEATURES = 192
RIDGE = 0.3
SEED = 20240501
#: Raw scores are counted in this many bins for the calibration, whatever the data.
BINS, LOW, HIGH = 2000, -1.0, 2.0

# Byte classes: lower, upper, digit, space, line end, symbol, sentence sign, other sign, beyond ASCII.
_CLASS = np.full(256, 7, "u1")
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[list(b"#*$%&|<>")] = 5
_CLASS[list(b".,;:?'\"()-")] = 6
_CLASS[0x80:] = 8
N_STATS = 19


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; all 0 for one without words, but for the last, which says so."""
    words = text.split()
    if not words:
        return [0.0] * (N_STATS - 1) + [1.0]
    raw = text.encode()
    shares = np.bincount(_CLASS[np.frombuffer(raw, "u1")], minlength=9) / len(raw)
    lines = text.split("\n")
    sentences = text.split(".")
    n = len(words)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        *np.sqrt(shares).tolist(),
        np.log1p(n),
        np.log1p(len(raw) / n),
        distinct / n,
        # repetition that does not follow from length alone
        np.log(distinct) / np.log(n) if n > 1 else 1.0,
        pairs / (n - 1) if n > 1 else 1.0,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        len(set(sentences)) / len(sentences),
        np.log1p(n / len(lines)),
        0.0,
    ]


@dataclass(frozen=True)
class Features:
    """Standardised statistics and their random Fourier features."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @staticmethod
    def drawn(mean: np.ndarray, scale: np.ndarray, n: int = N_FEATURES, seed: int = SEED) -> Features:
        rng = np.random.default_rng(seed)
        d = len(mean)
        return Features(mean, scale, rng.normal(size=(d, n)) / np.sqrt(2 * d), rng.uniform(0, 2 * np.pi, n))

    @property
    def size(self) -> int:
        return len(self.phases) + len(self.mean) + 1

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([waves, x / np.sqrt(x.shape[1]), np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    features: Features
    weights: np.ndarray
    scores: np.ndarray  # of the calibration's steps
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        fitted = np.interp(raw, self.scores, self.values) if len(self.scores) else np.full(len(raw), 0.5)
        order = 1 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30)))  # keeps texts of one step in order
        return 0.98 * fitted + 0.02 * order


def statistics_table(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, stats), one row per document."""

    def each(ids: list, texts: list) -> dict[str, list]:
        return {"doc_id": ids, "stats": [statistics(t) for t in texts]}

    return stored(map_texts(id_and_text(docs), each, "doc_id bigint, stats array<double>"), "statistics")


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _normal_equations(rows: DataFrame, features: Features) -> dict[int, np.ndarray]:
    """Sums of z z' by fold, where z is a row's features followed by its label.

    Each partition sums its rows, and partial sums are added by (fold, row of the matrix), so that no task or driver
    sees more than the matrix's own size at a time.
    """
    size = features.size + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size))
        for batch in batches:
            z = np.hstack([features(_matrix(batch, 2)), batch.column(1).to_numpy(zero_copy_only=False)[:, None].astype(float)])
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            for f in (0, 1):
                part = z[fold == f]
                total[f] += part.T @ part
        if total.any():
            yield pa.RecordBatch.from_pydict(
                {"fold": np.repeat([0, 1], size), "line": np.tile(np.arange(size), 2), "sums": list(total.reshape(2 * size, size))}
            )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for fold, line, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _matrix(batch, 2), strict=True):
                key = (fold, line)
                total[key] = total[key] + part if key in total else part.copy()
        if total:
            yield pa.RecordBatch.from_pydict({"fold": [k[0] for k in total], "line": [k[1] for k in total], "sums": list(total.values())})

    schema = "fold bigint, line bigint, sums array<double>"
    partial = rows.select("fold", "label", "stats").mapInArrow(sums, schema)
    out = {f: np.zeros((size, size)) for f in (0, 1)}
    for row in partial.repartition("fold", "line").mapInArrow(added, schema).collect():  # 2 * size rows
        out[row["fold"]][row["line"]] = row["sums"]
    return out


def _solve(total: np.ndarray, ridge: float) -> np.ndarray:
    a, b = total[:-1, :-1], total[:-1, -1]
    penalty = np.full(len(a), ridge)
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b) if total.any() else np.zeros(len(a))


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of ``x``: mean positions and rising shares of positives."""
    pools: list[list[float]] = []
    for xi, ni, pi in zip(x, n, positive, strict=True):
        pools.append([xi * ni, float(ni), float(pi)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = HELD_OUT) -> Model:
    """A model from the labelled rows whose id's remainder is not the held-out one; all of them are summed.

    Without any such row every score is about 0.5.
    """
    modulus, remainder = held_out
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.filter(id_remainder(F.col("doc_id"), modulus) != remainder)
    marked = marked.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    fold = (F.xxhash64("doc_id") % 2 != 0).cast("bigint")
    rows = stored(stats.join(marked, "doc_id").select("doc_id", fold.alias("fold"), "label", "stats"), "training")
    moments = rows.select(
        *(F.avg(F.get("stats", F.lit(i))).alias(f"m{i}") for i in range(N_STATS)),
        *(F.stddev_pop(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(N_STATS)),
    ).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(N_STATS)])
    scale = np.maximum([moments[f"s{i}"] or 0.0 for i in range(N_STATS)], 0.02)
    features = Features.drawn(mean, scale)
    sums = _normal_equations(rows, features)
    other = np.stack([_solve(sums[1], RIDGE), _solve(sums[0], RIDGE)])  # for rows of fold 0, of fold 1

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.einsum("ij,ij->i", features(_matrix(batch, 2)), other[batch.column(0).to_numpy(zero_copy_only=False)])
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], names=["bin", "label"])

    counts = (
        rows.select("fold", "label", "stats")
        .mapInArrow(binned, "bin bigint, label double")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive"))
        .orderBy("bin")
        .collect()  # BINS rows at most
    )
    at = np.array([LOW + (c["bin"] + 0.5) * (HIGH - LOW) / BINS for c in counts])
    scores, values = isotonic(at, np.array([c["n"] for c in counts]), np.array([c["positive"] for c in counts]))
    return Model(features, _solve(sums[0] + sums[1], RIDGE), scores, values)


def classify(stats: DataFrame, model: Model, held_out: tuple[int, int] = HELD_OUT, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(_matrix(batch, 1)))], names=["doc_id", "score"])

    scored = stats.select("doc_id", "stats").mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"),
        "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"),
    )


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; NULL and empty texts get the score of a text without words."""
    stats = statistics_table(docs)
    return classify(stats, fit(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, scored in place.

    A NULL text is scored as an empty one; repeated rows are kept or rejected alike; an empty table stays empty.
    """
    model = fit(statistics_table(docs), labels)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        # slices, so that a worker holds few texts as strings at a time
        parts = (texts.slice(at, DOCS_PER_CALL).to_pylist() for at in range(0, len(texts), DOCS_PER_CALL))
        found = [model(np.array([statistics(t) for t in part])) for part in parts]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) >= cutoff)
