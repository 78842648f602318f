"""Ranked lexical search by a document FP-tree and branch-and-bound.

A document is kept as its term vector restricted to the items' terms.  A task sorts the vectors of its documents, terms in
order of falling document frequency, so that vectors with a common start share a path of a trie.  The trie's nodes are
stretches of that order; each knows, over the documents below it, the largest tf of every term and the smallest m, which bound
the score of any of them for an item.  Per item the nodes are searched depth first, best bound first, and a node whose bound
does not reach the tenth score found so far is left out.  Tasks hand on ten documents an item, which are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import DOCS_PER_CALL, id_and_text, stored

TOP = 10
#: Distinct terms of items searched at a time; bounds what is sent to every task.
BLOCK_TERMS = 500_000
#: Vector entries a task puts into one tree.
TREE_ENTRIES = 1_500_000
#: Documents below a node that is not divided further.
LEAF_DOCS = 48
_BREAKS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms in order; every byte of a character beyond ASCII belongs to a term."""
    return text.encode().translate(_BREAKS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """Items with at least one term: number of the row, ``item_id`` and distinct ``terms``; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])

    rows = id_and_text(items, "item_id").select(F.monotonically_increasing_id().alias("item"), F.col("doc_id").alias("item_id"), "text")
    return stored(rows.mapInArrow(run, "item bigint, item_id bigint, terms array<binary>").filter(F.size("terms") > 0), "items")


def restricted_vectors(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Documents with a term: ``doc_id``, length ``n``, and the numbers and tf of those terms that ``numbers`` has; stored."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_PER_CALL):
                part = batch.slice(at, DOCS_PER_CALL)
                lengths, terms, counts = [], [], []
                for text in part.column(1).to_pylist():
                    words = terms_of(text)
                    tf = Counter(map(known.get, words))
                    tf.pop(None, None)
                    lengths.append(len(words))
                    terms.append(np.fromiter(tf.keys(), "<u4", len(tf)).tobytes())
                    counts.append(np.fromiter(tf.values(), "<u4", len(tf)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
                    names=["doc_id", "n", "terms", "tf"],
                )

    found = id_and_text(docs).mapInArrow(run, "doc_id bigint, n bigint, terms binary, tf binary")
    return stored(found.filter("n > 0"), "vectors")


def document_frequencies(vectors: DataFrame) -> DataFrame:
    """``term`` and in how many documents it is, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1, "i8")
        for batch in batches:
            terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            here = np.bincount(terms, minlength=len(sums))
            here[: len(sums)] += sums
            sums = here
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["term", "df"])

    return vectors.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """The FP-tree of some documents, as nodes over their sorted vectors.

    ``term`` and ``tf`` hold the entries of document ``d`` from ``first[d]`` to ``first[d + 1]``; ``term`` is the rank of a
    term by falling document frequency, of ``n_terms``.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        counts = np.diff(first)
        order = np.lexsort((term, np.repeat(np.arange(len(ids)), counts)))
        term, tf = term[order], tf[order]
        key = term.astype(">u4").tobytes()
        keys = [key[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        docs = np.array(sorted(range(len(ids)), key=keys.__getitem__), "i8")
        counts = counts[docs]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        moved = np.repeat(first[docs] - self.first[:-1], counts) + np.arange(self.first[-1])
        self.term, self.tf = term[moved], tf[moved]
        self.ids, self.m, self.n_terms = ids[docs], m[docs], n_terms
        self.doc = np.repeat(np.arange(len(docs)), counts)
        self._divide()

    def _common(self) -> np.ndarray:
        """Terms that each vector's path shares with the one before."""
        out = np.zeros(len(self.ids), "i8")
        first, term = self.first.tolist(), self.term
        for d in range(1, len(out)):
            a, b, end = first[d - 1], first[d], first[d + 1]
            k = min(b - a, end - b)
            differ = np.flatnonzero(term[a : a + k] != term[b : b + k])
            out[d] = differ[0] if len(differ) else k
        return out

    def _divide(self) -> None:
        """Nodes by branching of the paths; those with few documents are leaves, small neighbours share one.

        A branch that keeps more than half of its node's documents has no bounds of its own: its branches count as the node's,
        so a document is in few nodes however deep its path.
        """
        common = self._common()
        spans, children, leaf = [(0, len(self.ids))], [[]], [len(self.ids) <= LEAF_DOCS]
        work = [(0, 0, len(self.ids))] if not leaf[0] else []
        while work:
            node, low, high = work.pop()
            inner = common[low + 1 : high]
            cuts = (low + 1 + np.flatnonzero(inner == inner.min())).tolist()
            size = spans[node][1] - spans[node][0]
            held = low
            edges = [low, *cuts, high]

            def add(a: int, b: int, is_leaf: bool, node: int = node) -> int:
                spans.append((a, b))
                children.append([])
                leaf.append(is_leaf)
                children[node].append(len(spans) - 1)
                return len(spans) - 1

            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > LEAF_DOCS:
                    if a > held:
                        add(held, a, True)
                    if 2 * (b - a) > size:
                        work.append((node, a, b))
                    else:
                        work.append((add(a, b, False), a, b))
                    held = b
                elif b - held > LEAF_DOCS:
                    add(held, b, True)
                    held = b
            if high > held:
                add(held, high, True)
        self.spans, self.children, self.leaf = spans, children, leaf
        self.least_m = np.array([self.m[a:b].min() for a, b in spans])
        self.least_id = np.array([self.ids[a:b].min() for a, b in spans])
        nodes, terms, most = [], [], []
        largest = np.zeros(self.n_terms, "i8")
        for node, (a, b) in enumerate(spans):
            term, tf = self.term[self.first[a] : self.first[b]], self.tf[self.first[a] : self.first[b]]
            np.maximum.at(largest, term, tf)
            here = np.flatnonzero(largest) if len(term) > self.n_terms else np.unique(term)
            nodes.append(np.full(len(here), node))
            terms.append(here)
            most.append(largest[here])
            largest[here] = 0
        nodes, terms, most = np.concatenate(nodes), np.concatenate(terms), np.concatenate(most)
        by_term = np.argsort(terms, kind="stable")
        self.node_of, self.most = nodes[by_term], most[by_term]
        self.gain_of = gain(self.most, self.least_m[self.node_of])
        self.term_first = np.searchsorted(terms[by_term], np.arange(self.n_terms + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per node, what no document below it exceeds."""
        out = np.zeros(len(self.spans), "i8")
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            a, b = self.term_first[t], self.term_first[t + 1]
            out[self.node_of[a:b]] += w * self.gain_of[a:b]
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, scratch: np.ndarray, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``best``, (-score, id) of at most ``TOP`` documents in order, with this tree's documents merged in.

        ``scratch`` holds a zero for every term and is left so.
        """
        bound = self.bounds(terms, weights)
        scratch[terms] = weights
        stack = [0]
        while stack:
            node = stack.pop()
            limit = int(bound[node])
            if limit == 0 or (len(best) == TOP and (-limit, int(self.least_id[node])) > best[-1]):
                continue
            if not self.leaf[node]:
                # the best branch is taken first
                stack.extend(sorted(self.children[node], key=bound.__getitem__))
                continue
            a, b = self.spans[node]
            low, high = self.first[a], self.first[b]
            w = scratch[self.term[low:high]]
            at = low + np.flatnonzero(w)
            doc = self.doc[at]
            scores = np.zeros(b - a, "i8")
            np.add.at(scores, doc - a, w[at - low] * gain(self.tf[at], self.m[doc]))
            least = max(1, -best[-1][0]) if len(best) == TOP else 1
            for d in np.flatnonzero(scores >= least).tolist():
                best.append((-int(scores[d]), int(self.ids[a + d])))
            best.sort()
            del best[TOP:]
        scratch[terms] = 0
        return best


_NO_ID = np.iinfo("i8").max


def _trees(batches: Iterator[pa.RecordBatch], rank: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Tree]:
    """Trees of the documents that have a term of an item, of at most about ``TREE_ENTRIES`` entries."""
    held: list[tuple] = []
    entries = 0

    def tree() -> Tree:
        ids, n, terms, tf = (np.concatenate(c) if i < 2 else c for i, c in enumerate(zip(*held, strict=True)))
        terms, tf = [t for part in terms for t in part], [t for part in tf for t in part]
        first = np.concatenate([[0], np.cumsum([len(t) // 4 for t in terms])]).astype("i8")
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        return Tree(ids, m, first, rank[np.frombuffer(b"".join(terms), "<u4")], np.frombuffer(b"".join(tf), "<u4").astype("i8"), len(rank))

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            if part.num_rows == 0:
                continue
            ids = part.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            terms, tf = part.column(2).to_pylist(), part.column(3).to_pylist()
            held.append((ids, part.column(1).to_numpy(zero_copy_only=False), terms, tf))
            entries += sum(map(len, terms)) // 4
            if entries > TREE_ENTRIES:
                yield tree()
                held.clear()
                entries = 0
    if held:
        yield tree()


def _search(vectors: DataFrame, items: list[tuple[int, list[int]]], rank: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """The best documents of each task for each item: ``item``, ``doc_id``, ``score``.  ``weights`` are by rank."""
    sent = vectors.sparkSession.sparkContext.broadcast((items, rank, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, rank, weights = sent.value
        wanted = [(item, np.sort(rank[np.array(terms)])) for item, terms in items]
        best: dict[int, list] = {item: [] for item, _ in items}
        scratch = np.zeros(len(rank), "i8")
        for tree in _trees(batches, rank, n_docs, n_terms):
            for item, terms in wanted:
                best[item] = tree.search(terms, weights[terms], scratch, best[item])
        rows = [(item, None if d == _NO_ID else d, -s) for item, found in best.items() for s, d in found]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return vectors.filter(F.length("terms") > 0).mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ``TOP`` highest-scoring documents of each row of ``items`` (item_id, text), equal scores by ascending ``doc_id``.

    Items are searched in blocks of at most about ``BLOCK_TERMS`` terms, each against all documents.  A NULL text has no terms;
    items and documents without terms have no rows; a NULL document id comes after all others; a repeated row is a document,
    or an item, of its own.
    """
    spark = docs.sparkSession
    asked = item_terms(items)
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    block_of = F.pmod(F.xxhash64("item"), F.lit(max(1, blocks)))
    found = []
    for block in range(blocks):
        rows = asked.filter(block_of == block).collect()
        numbers: dict[bytes, int] = {}
        wanted = [(r["item"], [numbers.setdefault(bytes(t), len(numbers)) for t in r["terms"]]) for r in rows]
        vectors = restricted_vectors(docs, numbers)
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(numbers), "i8")
        for r in document_frequencies(vectors).collect():
            df[r["term"]] = r["df"]
        rank = np.empty(len(df), "i8")
        rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
        weights = np.zeros(len(df), "i8")
        weights[rank] = [weight(n_docs, int(d)) for d in df]
        found.append(_search(vectors, wanted, rank, weights, n_docs, n_terms))
    schema = "item bigint, doc_id bigint, score bigint"
    best = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


RANKED_SEARCH_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, totals WHERE term IN (SELECT term FROM wanted) GROUP BY term, docs),
scores AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms))))) AS BIGINT) AS score
    FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN size USING (doc_id), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
