"""Toxicity: a factorisation machine over hashed terms.

Texts become sets of hashed words.  Words that go with the labels are found from counts over all training rows; the
machine then learns a weight for each and a short vector whose products are the weights of pairs, such as an insult with
the mention of a group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import id_and_text, id_remainder, map_texts, stored

HELD_OUT = (5, 0)
CUTOFF = 0.5
BINS = 1 << 20
#: Labelled rows, in order of a hash of the id, that the machine is fitted on at most.
FIT_ROWS = 20_000
#: How far a term's share of positive rows is from that of all, in standard deviations, for the machine to know it.
LEAST_Z = 5.0
#: Rows of the usual share that are added to a term's own, where its weight comes from its counts alone.
PRIOR_ROWS = 3.0
FACTORS = 6
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.08, 2e-4
SEED = 20240502

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str) -> bytes:
    """Bins of the distinct words of the lower-cased text, sorted, as little-endian 32-bit numbers."""
    words = set(WORD.findall(text.encode().lower()))
    return np.unique(np.fromiter(map(zlib.crc32, words), "<u4", len(words)) & (BINS - 1)).astype("<u4").tobytes()


def term_table(docs: DataFrame) -> DataFrame:
    """(doc_id, terms) of every document."""

    def each(ids: list, texts: list) -> dict[str, list]:
        return {"doc_id": ids, "terms": [terms_of(t) for t in texts]}

    return map_texts(id_and_text(docs), each, "doc_id bigint, terms binary")


def _counts(rows: DataFrame) -> DataFrame:
    """Rows (term, n, positive): training documents with the term; each partition sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, positive = np.zeros(BINS, "i8"), np.zeros(BINS, "i8")
        for batch in batches:
            for terms, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = np.frombuffer(terms, "<u4")
                n[at] += 1
                positive[at] += label
        found = np.flatnonzero(n)
        for at in range(0, len(found), 50_000):
            part = found[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part]), pa.array(positive[part])], names=["term", "n", "positive"])

    partial = rows.select("terms", "label").mapInArrow(run, "term bigint, n bigint, positive bigint")
    return partial.groupBy("term").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))


@dataclass(frozen=True)
class Machine:
    terms: np.ndarray  # sorted bins
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def known(self, terms: bytes) -> np.ndarray:
        """Numbers of the machine's terms among these bins."""
        bins = np.frombuffer(terms, "<u4")
        if not len(self.terms):
            return np.zeros(0, "i8")
        at = np.searchsorted(self.terms, bins)
        at[at == len(self.terms)] = 0
        return at[self.terms[at] == bins]

    def __call__(self, many: list[bytes]) -> np.ndarray:
        return _probability(_margins(self.bias, self.weights, self.vectors, *_flat([self.known(t) for t in many]))[0])


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return rows, np.concatenate(sets) if sets else np.zeros(0, "i8"), len(sets)


def _probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _margins(bias: float, weights: np.ndarray, vectors: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int):
    """Of each row, with the sums of its terms' vectors; pairs by the usual (sum squared less squares) / 2."""
    sums = np.zeros((n, vectors.shape[1]))
    np.add.at(sums, rows, vectors[cols])
    squares = np.bincount(rows, (vectors[cols] ** 2).sum(1), n) if len(cols) else np.zeros(n)
    linear = np.bincount(rows, weights[cols], n) if len(cols) else np.zeros(n)
    return bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums


def train(sets: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = SEED) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors by mini-batches with per-weight rates (AdaGrad)."""
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    weights, vectors = np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))
    seen_w, seen_v, seen_b = np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(sets))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            rows, cols, n = _flat([sets[i] for i in part])
            margin, sums = _margins(bias, weights, vectors, rows, cols, n)
            slope = _probability(margin) - labels[part]
            g_b = slope.sum()
            seen_b += g_b**2
            bias -= RATE * g_b / np.sqrt(seen_b)
            if not len(cols):
                continue
            used, back = np.unique(cols, return_inverse=True)
            g_w = np.bincount(back, slope[rows]) + DECAY * n * weights[used]
            g_v = np.zeros((len(used), FACTORS))
            np.add.at(g_v, back, slope[rows, None] * (sums[rows] - vectors[cols]))
            g_v += DECAY * n * vectors[used]
            seen_w[used] += g_w**2
            seen_v[used] += g_v**2
            weights[used] -= RATE * 4 * g_w / np.sqrt(seen_w[used])
            vectors[used] -= RATE * g_v / np.sqrt(seen_v[used])
    return bias, weights, vectors


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = HELD_OUT) -> Machine:
    """A machine from the labelled rows whose id's remainder is not the held-out one.

    Terms are chosen by counts over all of them, however rare or many: each hashed bin is one number at most.  Weights and
    vectors come from at most ``FIT_ROWS`` rows; a term that is in none of these has the weight that its counts over all rows
    give, so that rare terms count at every corpus size.  Without a labelled row every score is about one half.
    """
    modulus, remainder = held_out
    marked = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.filter(id_remainder(F.col("doc_id"), modulus) != remainder)
    marked = marked.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("bigint").alias("label"))
    # merged at every size: the labels grow with the documents, so their copy on each executor would too
    rows = stored(term_table(docs).join(marked.hint("merge"), "doc_id"), "marked-terms")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive")).first()
    share = (total["positive"] or 0) / max(1, total["n"])
    expected = F.col("n") * share
    z = F.abs(F.col("positive") - expected) / F.sqrt(expected * (1 - share) + 0.05)
    chosen = _counts(rows).filter(z >= LEAST_Z).collect()  # BINS rows at most
    chosen.sort(key=lambda c: c["term"])
    terms = np.array([c["term"] for c in chosen], "u4")
    empty = Machine(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), FACTORS)))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [empty.known(t).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column(2)], names=["doc_id", "terms", "label"])

    sample = (
        rows.select("doc_id", "terms", "label").mapInArrow(reduced, "doc_id bigint, terms binary, label bigint")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).collect()
    )
    sets = [np.frombuffer(r["terms"], "<u4").astype("i8") for r in sample]
    bias, weights, vectors = train(sets, np.array([r["label"] for r in sample], float), len(terms))
    unseen = np.ones(len(terms), bool)
    if sets:
        unseen[np.concatenate(sets)] = False
    n, positive = (np.array([c[name] for c in chosen], float)[unseen] for name in ("n", "positive"))
    usual = min(max(share, 1e-3), 1 - 1e-3)
    weights[unseen] = np.log((positive + PRIOR_ROWS * usual) / (n - positive + PRIOR_ROWS * (1 - usual))) - np.log(usual / (1 - usual))
    vectors[unseen] = 0
    return Machine(terms, bias, weights, vectors)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = HELD_OUT, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted).  A text without words has the bias as its score."""
    machine = fit(docs, labels, held_out=held_out)

    def each(ids: list, texts: list) -> dict[str, list]:
        return {"doc_id": ids, "score": machine([terms_of(t) for t in texts]).tolist()}

    scored = map_texts(id_and_text(docs), each, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        (id_remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"),
        "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"),
    )
