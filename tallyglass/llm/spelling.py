"""Spelling variants: words of a corpus's vocabulary that are one edit apart, by dynamic programming over sorted lists.

Two words one edit apart share a prefix of ``p`` letters before the edit and at least ``m - 1 - p`` letters after it, ``m``
being the shorter length.  So the sorted vocabulary is cut into lists of words that agree before and behind a stretch where
the edit may be; the lists for ``p`` below and from half of ``m`` on hold every pair, each once.  A list that is too long is
cut again, at the middle of its stretch.  In a list, one scan per word goes through the sorted rest and keeps the rows of a
three-wide edit matrix: the next word starts at the row of its common prefix with the last one, and where a prefix is more
than one edit away all words that have it are skipped.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import DOCS_PER_CALL, id_and_text, stored

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as the word.
FORM_TIMES = 5
#: One in so many runs of a document loses a letter.
MISPRINT = 199
#: Words in a list beyond which it is cut again.
LIST_WORDS = 4000
#: Words a task counts before it hands its counts on.
HELD_WORDS = 400_000
_RUN = re.compile("[a-zÀ-ÿ]+")
_ABOVE = "\U0010ffff"


def document_words(doc_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """The runs of a text, with misprints and the number of times each occurs; runs too short to count are left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, times in Counter(_RUN.findall(text.encode().lower().decode())).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % MISPRINT == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, times


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and its number of occurrences ``n`` over all documents, for words with at least ``least``; stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_PER_CALL):
                part = batch.slice(at, DOCS_PER_CALL)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for word, times in document_words(doc_id, text):
                        held[word] += times
                    if len(held) > HELD_WORDS:
                        yield out()
                        held.clear()
        yield out()

    counted = id_and_text(docs).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.filter(F.col("n") >= least), "vocabulary")


def _halves(start: Column, end: Column) -> Column:
    """The two halves of the stretch [start, end) in which a pair's common prefix ends."""
    middle = F.floor((start + end) / 2).cast("int")
    return F.array(F.struct(start.alias("start"), middle.alias("end")), F.struct(middle.alias("start"), end.alias("end")))


def _lists(rows: DataFrame) -> DataFrame:
    """``rows`` of (word, n, shorter, half) with the list each belongs to and the stretch of the word that is free there."""
    tail = F.greatest(F.lit(0), F.col("shorter") - F.col("half.end"))
    length = F.length("word")
    return rows.select(
        "word",
        "n",
        "shorter",
        F.col("half.start").alias("start"),
        F.col("half.end").alias("end"),
        F.concat_ws(" ", "shorter", "half.start", F.substring("word", F.lit(1), F.col("half.start")), F.substring("word", length - tail + 1, tail)).alias("list"),
        F.substring("word", F.col("half.start") + 1, length - F.col("half.start") - tail).alias("free"),
    )


def pairs_in_list(words: list[str], shorter: int, prefix_end: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of a sorted list that are one edit apart.

    Only pairs whose shorter word has ``shorter`` letters and whose common prefix is below ``prefix_end``.
    """
    size = len(words)
    common = [0] * size
    for j in range(1, size):
        a, b, k = words[j - 1], words[j], 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            k += 1
        common[j] = k
    for i in range(size - 1):
        word = words[i]
        length = len(word)
        # rows[d]: edits between the first d letters of the list's word and the first d - 1, d, d + 1 letters of this one
        rows = [(1, 0, 1)] * (length + 1)
        kept = length  # rows up to here hold for the common prefix with the last word looked at
        j, shared = i + 1, common[i + 1]
        while True:
            other = words[j]
            d = min(kept, shared)
            del rows[d + 1 :]
            left, mid, right = rows[d]
            dead = 0
            reach = min(len(other), length + 2)
            while d < reach:
                c = other[d]
                new_left = min(left + (d == 0 or d > length or c != word[d - 1]), mid + 1)
                new_mid = min(mid + (d >= length or c != word[d]), right + 1, new_left + 1)
                new_right = min(right + (d + 1 >= length or c != word[d + 1]), new_mid + 1)
                d += 1
                if new_left > 1 and new_mid > 1 and new_right > 1:
                    dead = d
                    break
                left, mid, right = new_left, new_mid, new_right
                rows.append((left, mid, right))
            if not dead:
                gap = length - len(other)
                edits = left if gap == -1 else mid if gap == 0 else right if gap == 1 else 2
                if edits == 1 and min(length, len(other)) == shorter:
                    k = 0
                    for x, y in zip(word, other, strict=False):
                        if x != y:
                            break
                        k += 1
                    if k < prefix_end:
                        yield i, j
                kept = d
                j += 1
                if j == size:
                    break
                shared = common[j]
            else:
                # all words with this prefix are more than one edit away
                kept = dead - 1
                j = bisect_left(words, other[:dead] + _ABOVE, j + 1)
                if j == size:
                    break
                shared = 0
                for x, y in zip(other, words[j], strict=False):
                    if x != y:
                        break
                    shared += 1


def _scan(rows: DataFrame) -> DataFrame:
    """Near pairs of the lists, each in both directions: ``word``, ``near`` and ``near_n``."""
    schema = "word string, near string, near_n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])

        def ready() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])
            for column in out:
                column.clear()
            return made

        def close(group: list[tuple]) -> None:
            if len(group) < 2:
                return
            _, shorter, start, end, *_ = group[0]
            shorter -= start + max(0, shorter - end)
            free = [g[4] for g in group]
            if all(len(f) > shorter for f in free):
                return
            for i, j in pairs_in_list(free, shorter, end - start):
                (a, a_n), (b, b_n) = group[i][5:], group[j][5:]
                out[0].extend((a, b))
                out[1].extend((b, a))
                out[2].extend((b_n, a_n))

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    close(group)
                    group = []
                    if len(out[0]) > 20_000:
                        yield ready()
                group.append(row)
        close(group)
        yield ready()

    dealt = rows.repartition("list").sortWithinPartitions("list", "free")
    return dealt.select("list", "shorter", "start", "end", "free", "word", "n").mapInArrow(run, schema)


def near_words(words: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """All pairs of ``words`` (word, n) that differ by one edit, in both directions: ``word``, ``near``, ``near_n``.

    Words are distinct and have at least ``LEAST_LENGTH`` letters.  Lists with more than ``list_words`` words are cut at the
    middle of their stretch until they are short or the stretch is one place, where a list has at most two free letters.
    """
    spark = words.sparkSession
    shorter = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda m: m >= LEAST_LENGTH)
    rows = words.select("word", "n", F.explode(shorter).alias("shorter"))
    rows = rows.select("word", "n", "shorter", F.explode(_halves(F.lit(0), F.col("shorter") + 1)).alias("half"))
    found = []
    while True:
        lists = _lists(rows)
        long = stored(lists.groupBy("list").count().filter(F.col("count") > list_words).select("list"), "long-lists")
        if long.isEmpty():
            found.append(_scan(lists))
            break
        single = F.col("end") - F.col("start") <= 1
        cut = lists.join(long, "list", "left_semi").filter(~single)
        found += [_scan(lists.join(long, "list", "left_anti")), _scan(lists.join(long, "list", "left_semi").filter(single))]
        rows = cut.select("word", "n", "shorter", F.explode(_halves(F.col("start"), F.col("end"))).alias("half"))
        rows = stored(rows, "cut-lists")
        if rows.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def _roots(links: DataFrame) -> DataFrame:
    """The last word reached from each ``word`` by its ``form`` and the forms after it.

    Every round doubles the steps taken; counts grow by ``FORM_TIMES`` with each step, so a few rounds reach all ends.
    """
    reached = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        a, b = reached.alias("a"), reached.alias("b")
        stepped = a.join(b, F.col("a.root") == F.col("b.word"), "left").select(
            "a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")
        )
        stepped = stored(stepped, "roots")
        reached = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, list_words: int = LIST_WORDS) -> DataFrame:
    """One row per word of the documents' vocabulary: its form, the root its forms lead to, and its near words' number.

    A NULL text has no words; a NULL id counts as the empty text where the id decides on misprints; repeated rows count
    again.  An empty table gives no rows.
    """
    words = vocabulary(docs)
    most = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(words, list_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), most.alias("most"))
    rows = words.join(near, "word", "left").withColumn("form_n", -F.col("most.less"))
    enough = F.col("form_n") >= FORM_TIMES * F.col("n")
    rows = stored(
        rows.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("most.near")).alias("form"),
            F.when(enough, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
