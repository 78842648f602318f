"""Concatenate and cut: documents as one stream of tokens, cut into windows of fixed length.

Pass one tokenises each document once and stores its ids with the number of tokens before it in its partition.  The
partitions' totals give every partition its offset in the whole stream; a document's place is then the sum of the two.
Pass two cuts each document at the multiples of the window length: a document that crosses a boundary leaves a piece
(boundary record) in each window it touches.  All windows but the last are full, so padding is less than one window.

The only rows that meet in one place are the partitions' totals, one small row per input partition.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import DOCS_PER_CALL, id_and_text, stored, worker_memory

WINDOW = 1024
END_ID = 0
#: Word pieces a worker remembers in each of two generations, some 130 MB each.
CACHED_PIECES = 600_000

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Characters whose class is the same in every Unicode version and regex library.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
#: The public pattern that splits text before the merges, spelled out for these characters.
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^ \t\n\r{_L}{_N}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
)


def _byte_signs() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the signs from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()
_SPACE_SIGN = _BYTE_SIGNS[0x20]


class Encoder:
    """Ids of texts by a tokenizer file, with a bounded memory of word pieces.

    Merges never cross the pieces the tokenizer splits a text into, so the ids of a text are those of its pieces.  Texts
    with other characters, or with a special token's string, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer  # noqa: PLC0415

        # a task has one core; threads of its own cost more than they save
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        before = (self.tokenizer.normalizer, type(self.tokenizer.pre_tokenizer).__name__, type(self.tokenizer.model).__name__)
        self.by_merges = before == (None, "ByteLevel", "BPE")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        plain = [_PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        split = [_SPLIT.findall(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.known) > CACHED_PIECES:
            # two generations: what is still in use comes back from the older one
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = [list(map(known.get, pieces)) for pieces in split]
        gaps = [None in ids for ids in found]
        missing = {p for pieces, ids, gap in zip(split, found, gaps, strict=True) if gap for p, x in zip(pieces, ids, strict=True) if x is None}
        known.update((piece, older[piece]) for piece in missing.intersection(older))
        for piece in missing.difference(older):
            known[piece] = self._piece(piece)
        return [
            (b"".join(map(known.__getitem__, pieces)) if gap else b"".join(ids)) if p else self._whole(t)
            for t, p, pieces, ids, gap in zip(texts, plain, split, found, gaps, strict=True)
        ]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece: by the merges alone where nothing but the split comes before them, which costs half as much."""
        if not self.by_merges:
            return self._whole(piece)
        if piece.isascii() and piece.isprintable():
            signs = piece.replace(" ", _SPACE_SIGN)
        else:
            signs = piece.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(signs)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _vocabulary(name: str) -> str:
    """Where an executor finds a tokenizer file."""
    import public_tokenizers  # noqa: PLC0415

    return public_tokenizers.path(name)


def token_table(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored rows (part, before, doc_id, doc_tokens, ids): each document's ids and its place in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = _vocabulary(tokenizer)
        encoder = worker_memory(f"pieces of {path}", lambda: Encoder(path))
        part, before = TaskContext.get().partitionId(), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_PER_CALL):
                rows = batch.slice(at, DOCS_PER_CALL)
                ids = [np.frombuffer(x + end, "<u4") for x in encoder.encode(rows.column(1).to_pylist())]
                sizes = np.array([len(x) for x in ids], "i8")
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, "i8")),
                        pa.array(starts),
                        rows.column(0),
                        pa.array(sizes),
                        # two bytes are enough for this vocabulary; four where one is larger
                        pa.array([x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in ids], pa.binary()),
                    ],
                    names=["part", "before", "doc_id", "doc_tokens", "ids"],
                )

    tokens = id_and_text(docs, id_col, text_col).mapInArrow(
        run, "part bigint, before bigint, doc_id bigint, doc_tokens bigint, ids binary"
    )
    return stored(tokens, "tokens")


def stream_offsets(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``place``, the document's first position in the whole stream."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # One row per input partition, so the window and the broadcast do not grow with the documents in them.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(bases), "part").withColumn("place", F.col("base") + F.col("before"))


def pack(tokens: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents in windows of ``window`` tokens; ``with_ids`` adds each piece's ids as binary.

    No document is empty, as each ends with ``END_ID``.  An empty table gives no pieces.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, n, blob, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                raw = memoryview(ids.tobytes())
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, window)
                    length = min(n - start, window - offset)
                    piece = raw[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(piece), n, sequence, offset)
                    out.append((*row, bytes(piece)) if with_ids else row)
                    start += length
            if out:
                names = [c.strip().split()[0] for c in schema.split(",")]
                types = [pa.int64()] * 7 + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names
                )

    return stream_offsets(tokens).select("doc_id", "doc_tokens", "ids", "place").mapInArrow(run, schema)


def concatenate_and_cut(docs: DataFrame, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """``pack`` of the documents' tokens.  A NULL text is the empty one and leaves a single end token."""
    return pack(token_table(docs), window, with_ids)
