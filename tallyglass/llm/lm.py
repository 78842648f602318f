"""Language-model scoring: word counts of all training documents, and a sharded Elias-Fano bigram trie.

Documents are encoded in chunks: each chunk keeps its tokens as numbers and its distinct words as hashes.

1.  Each chunk sends its distinct words with their training counts to shards by hash; the shards add them up and answer.
2.  Each chunk sends its distinct pairs of neighbouring words likewise, by the first word's hash; the few first words that
    are too frequent for one shard are spread by the second word too.  A shard builds its part of the trie from the
    counts, and answers every chunk from it.
3.  Each chunk puts the answers together and scores its documents.

With c the training count of word w, C that of the word v before it, N tokens, V distinct and M the prior's weight:
p1(w) = (c + 0.1) / (N + 0.1 (V + 1)) and p(w | v) = (c(v w) + M p1(w)) / (C + M).  The trie keeps c(v w) / (C + M),
quantised; the rest follows from the word counts.  A text begins after a start mark and ends with an end token.

Everything counted grows with the corpus and is spread over shards, whose number grows with it too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import id_and_text, id_remainder, stored
from tallyglass.llm.trie import Trie, restored

HELD_OUT = (10, 0)
PRIOR = 8.0
CHUNK_TOKENS = 600_000
SHARD_TOKENS = 1_200_000
END, START = b"", b" "  # no word is empty or a space
_HASH = {w: xxhash.xxh3_64_intdigest(w, 7) for w in (END, START)}


def _packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, the bytes of each rank together, after its length."""
    planes = np.ascontiguousarray(values).view("u1").reshape(len(values), -1).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(blob: bytes, dtype: str) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True), "u1")
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()


def _short(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to tell words apart within a pair's context, and a quarter less to send."""
    return np.ascontiguousarray((hashes >> np.uint64(16)).astype("<u8").view("u1").reshape(-1, 8)[:, :6]).tobytes()


def _from_short(blob: bytes) -> np.ndarray:
    full = np.zeros((len(blob) // 6, 8), "u1")
    full[:, :6] = np.frombuffer(blob, "u1").reshape(-1, 6)
    return full.view("<u8").ravel()


CHUNKS = "chunk bigint, doc_ids binary, has_id binary, held binary, sizes binary, codes binary, words binary, counts binary, tokens bigint"


def chunk_table(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """Stored chunks of encoded documents; ``counts`` are the chunk's training counts of its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0

        def fresh() -> tuple:
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            _ = numbers[END], numbers[START]
            return numbers, [], [], [], []

        numbers, ids, held, sizes, codes = fresh()
        total = 0

        def flush() -> pa.RecordBatch:
            code = np.concatenate(codes)
            size = np.array(sizes, "i8")
            train = np.repeat(~np.array(held, bool), size)
            counts = np.bincount(code[train], minlength=len(numbers))
            counts[1] = int((~np.array(held, bool)).sum())  # each training document begins once
            # frequent words get small numbers, which compress best
            order = np.argsort(-np.bincount(code, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), "u4")
            rank[order] = np.arange(len(order), dtype="u4")
            hashes = np.fromiter((_HASH.get(w) or xxhash.xxh3_64_intdigest(w, 7) for w in numbers), "u8", len(numbers))
            has = np.array([i is not None for i in ids], "u1")
            return pa.RecordBatch.from_pydict(
                {
                    "chunk": [base + number],
                    "doc_ids": [_packed(np.array([i or 0 for i in ids], "i8"))],
                    "has_id": [_packed(has)],
                    "held": [_packed(np.array(held, "u1"))],
                    "sizes": [_packed(size)],
                    "codes": [_packed(rank[code])],
                    "words": [_packed(hashes[order])],
                    "counts": [_packed(counts[order].astype("i8"))],
                    "tokens": [len(code)],
                }
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, is_held, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    words = text.encode().lower().split()
                    code = np.fromiter(map(numbers.__getitem__, words), "u4", len(words))
                    ids.append(doc_id)
                    held.append(is_held)
                    sizes.append(len(words) + 1)
                    codes.append(np.append(code, np.uint32(0)))
                    total += len(words) + 1
                    if total >= CHUNK_TOKENS:
                        yield flush()
                        numbers, ids, held, sizes, codes = fresh()
                        total, number = 0, number + 1
        if ids:
            yield flush()

    rows = id_and_text(docs).select(
        "doc_id", (id_remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held"), "text"
    )
    return stored(rows.mapInArrow(run, CHUNKS), "chunks")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, "i8")
    return starts, np.diff(np.append(starts, len(values)))


def _groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of a column, in a sorted partition."""
    key, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                value = row[batch.schema.names[column]]
                if rows and value != key:
                    yield key, rows
                    rows = []
                key = value
                rows.append(row)
    if rows:
        yield key, rows


def _shard_order(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = (hashes % np.uint64(shards)).astype("i8")
    return np.argsort(shard, kind="stable"), shard


def word_answers(chunks: DataFrame, shards: int) -> DataFrame:
    """Stored rows (chunk, shard, counts): training counts of a chunk's words in a shard, in the chunk's order; a row
    with chunk -1 has the shard's tokens, distinct words and words frequent enough to be spread."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = _unpacked(row["words"], "u8"), _unpacked(row["counts"], "i8")
                order, shard = _shard_order(words, shards)
                starts, sizes = _runs(shard[order])
                at = [order[s : s + n] for s, n in zip(starts, sizes, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": shard[order][starts],
                        "chunk": np.full(len(starts), row["chunk"]),
                        "words": [_packed(words[a]) for a in at],
                        "counts": [_packed(counts[a]) for a in at],
                    }
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches):
            words = [_unpacked(r["words"], "u8") for r in rows]
            names, back = np.unique(np.concatenate(words), return_inverse=True)
            counts = np.zeros(len(names), "i8")
            np.add.at(counts, back, np.concatenate([_unpacked(r["counts"], "i8") for r in rows]))
            per = np.split(counts[back], np.cumsum([len(w) for w in words])[:-1])
            real = counts * (names != np.uint64(_HASH[START]))
            largest = np.argsort(-counts, kind="stable")[:64]
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": [r["chunk"] for r in rows] + [-1],
                    "shard": [shard] * (len(rows) + 1),
                    "counts": [_packed(c) for c in per]
                    + [_packed(np.concatenate([[real.sum(), (real > 0).sum()], names[largest].view("i8"), counts[largest]]).astype("i8"))],
                }
            )

    asked = chunks.select("chunk", "words", "counts").mapInArrow(ask, "shard bigint, chunk bigint, words binary, counts binary")
    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", "chunk")
    return stored(dealt.mapInArrow(answer, "chunk bigint, shard bigint, counts binary"), "word-answers")


def totals(answers: DataFrame, shards: int) -> tuple[int, int, dict[int, int]]:
    """Tokens, distinct words, and the counts of words that hold over a quarter of a shard's share of the tokens.

    There are at most 4 such words per shard on average; each shard offers its 64 most frequent ones.
    """
    rows = [_unpacked(r["counts"], "i8") for r in answers.filter("chunk = -1").select("counts").collect()]
    n, v = sum(int(r[0]) for r in rows), sum(int(r[1]) for r in rows)
    hot = {}
    for r in rows:
        k = (len(r) - 2) // 2
        for name, count in zip(r[2 : 2 + k].view("u8").tolist(), r[2 + k :].tolist(), strict=True):
            if count * 4 * shards > n and count:
                hot[name] = count
    return n, v, hot


def _pairs(row: dict, shards: int, hot: np.ndarray):
    """The distinct pairs of a chunk in the order in which it asks for them: by shard, first word, second word."""
    words, codes, sizes = _unpacked(row["words"], "u8"), _unpacked(row["codes"], "u4").astype("i8"), _unpacked(row["sizes"], "i8")
    start = int(np.flatnonzero(words == np.uint64(_HASH[START]))[0])
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[np.cumsum(sizes) - sizes] = start
    distinct, back = np.unique(before * len(words) + codes, return_inverse=True)
    first, second = words[distinct // len(words)], words[distinct % len(words)]
    spread = np.isin(first, hot)
    shard = ((first + np.where(spread, second >> np.uint64(9), np.uint64(0))) % np.uint64(shards)).astype("i8")
    order = np.lexsort((second, first, shard))
    return words, codes, before, sizes, back, order, first, second, shard


def pair_answers(chunks: DataFrame, shards: int, hot: dict[int, int], prior: float = PRIOR) -> DataFrame:
    """Rows (chunk, shard, codes): quantised probabilities from the trie for a chunk's pairs in a shard.

    They are read once, by the exchange that brings them to their chunks, so they are not stored besides.
    """
    hot_names = np.array(sorted(hot), "u8")
    hot_counts = {name >> 16: count for name, count in hot.items()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes, _, sizes, back, order, first, second, shard = _pairs(row, shards, hot_names)
                train = np.repeat(_unpacked(row["held"], "u1") == 0, sizes)
                counts = np.bincount(back[train], minlength=len(first))
                starts, lengths = _runs(shard[order])
                for s, n in zip(starts, lengths, strict=True):
                    at = order[s : s + n]
                    heads, runs = _runs(first[at])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": [shard[at[0]]],
                            "chunk": [row["chunk"]],
                            "first": [_short(first[at][heads])],
                            "runs": [_packed(runs.astype("u4"))],
                            "second": [_short(second[at])],
                            "counts": [_packed(counts[at].astype("u4"))],
                        }
                    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _groups(batches):
            runs = [_unpacked(r["runs"], "u4") for r in rows]
            first = np.concatenate([np.repeat(_from_short(r["first"]), n) for r, n in zip(rows, runs, strict=True)])
            seconds = [_from_short(r["second"]) for r in rows]
            second = np.concatenate(seconds)
            counts = np.concatenate([_unpacked(r["counts"], "u4") for r in rows]).astype("i8")
            seen = counts > 0
            names, name_no = np.unique(first[seen], return_inverse=True)
            others, other_no = np.unique(second[seen], return_inverse=True)
            pairs, pair_no = np.unique(name_no.astype("i8") * max(1, len(others)) + other_no, return_inverse=True)
            together = np.bincount(pair_no, counts[seen], len(pairs))
            name_of = pairs // max(1, len(others))
            context = np.bincount(name_of, together, len(names))
            for i in np.flatnonzero(np.isin(names, hot_names >> np.uint64(16))):
                context[i] = hot_counts[int(names[i])]
            trie = Trie(names[name_of], others[pairs % max(1, len(others))], together / (context[name_of] + prior))
            codes = trie(first, second)
            parts = np.split(codes, np.cumsum([len(s) for s in seconds])[:-1])
            for r, part in zip(rows, parts, strict=True):
                yield pa.RecordBatch.from_pydict({"chunk": [r["chunk"]], "shard": [shard], "codes": [_packed(part)]})

    asked = chunks.select("chunk", "held", "sizes", "codes", "words").mapInArrow(
        ask, "shard bigint, chunk bigint, first binary, runs binary, second binary, counts binary"
    )
    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", "chunk")
    return dealt.mapInArrow(answer, "chunk bigint, shard bigint, codes binary")


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def lm_scores(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT, prior: float = PRIOR) -> DataFrame:
    """One row per document; a NULL or empty text is a lone end token.

    A row counts for training by its id alone, so repeated rows count repeatedly.  Words are told apart by 64-bit hashes,
    the words of pairs by 48 bits of them.  Without training documents every token has probability 1 by the base formula.
    """
    chunks = chunk_table(docs, held_out)
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    shards = max(8, -(-tokens // SHARD_TOKENS))
    words = word_answers(chunks, shards)
    n, v, hot = totals(words, shards)
    pairs = pair_answers(chunks, shards, hot, prior)
    hot_names = np.array(sorted(hot), "u8")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            row = rows[0]
            names, codes, before, sizes, back, order, *_ = _pairs(row, shards, hot_names)
            by_shard, _ = _shard_order(names, shards)
            count = np.empty(len(names), "i8")
            count[by_shard] = np.concatenate([_unpacked(r["answer"], "i8") for r in rows if r["kind"] == 1])
            trie = np.empty(len(order))
            trie[order] = restored(np.concatenate([_unpacked(r["answer"], "<u2") for r in rows if r["kind"] == 2]))
            base = (count[codes] + 0.1) / (n + 0.1 * (v + 1))
            context = count[before]
            p = np.where(context > 0, trie[back] + prior / (context + prior) * base, base)
            starts = np.cumsum(sizes) - sizes
            has = _unpacked(row["has_id"], "u1")
            ids = _unpacked(row["doc_ids"], "i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=has == 0),
                    pa.array(_unpacked(row["held"], "u1") == 1),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((count[codes] > 0).astype("i8"), starts)),
                    pa.array(np.full(len(ids), n)),
                    pa.array(np.add.reduceat(np.log10(base), starts)),
                    pa.array(np.add.reduceat(np.log10(p), starts)),
                ],
                names=[c.split()[0] for c in SCORES.split(", ")],
            )

    own = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("shard"), F.lit(None).cast("binary").alias("answer"),
                        "doc_ids", "has_id", "held", "sizes", "codes", "words")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("doc_ids", "has_id", "held", "sizes", "codes", "words")]
    rows = own.unionByName(words.filter("chunk >= 0").select("chunk", F.lit(1).alias("kind"), "shard", F.col("counts").alias("answer"), *nothing))
    rows = rows.unionByName(pairs.select("chunk", F.lit(2).alias("kind"), "shard", F.col("codes").alias("answer"), *nothing))
    dealt = rows.repartition(shards, "chunk").sortWithinPartitions("chunk", "kind", "shard")
    return dealt.mapInArrow(score, SCORES)
