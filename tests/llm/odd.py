"""A small documents table with every awkward row, and the empty one."""

import random

from pyspark.sql import types as T

CLASHING = ["__row", "__piece", "__text", "__words", "__places", "__id", "__class", "held", "number", "after", "piece", "digest", "batch", "item", "rank", "list"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names the operators use inside
        T.StructField("row", T.LongType()),
        T.StructField("size", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("run", T.LongType()),
        T.StructField("unit", T.LongType()),
        T.StructField("member", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("held_out", T.BooleanType()),
        *(T.StructField(name, T.StringType()) for name in CLASHING),
    ]
)
LABELS = "doc_id bigint, quality int, toxic int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n)) + "."


def texts() -> list[tuple]:
    long_text = prose(1, 30_000)
    base = prose(2, 120)
    near = base.replace(".", " more.")
    rows = [
        (1, base, "s1"),
        (2, base, "s1"),
        (2, base, "s1"),  # a repeated row
        (3, near, "s2"),
        (4, "", "s2"),
        (5, None, None),
        (None, "no id here, but a text under the MIT License", "s1"),
        (None, None, "s3"),
        (6, long_text, "s1"),
        (7, "Zażółć gęślą jaźń 😀 " * 3, ""),
        (8, " \n\t ", "s3"),
        (-9, 'token = "0123456789abcdef0123456789abcdef"', "s2"),
        (2**40, "one two three", "s2"),
        (10, "### $$$ %%%\n### $$$ %%%\n", "s1"),
    ]
    rows += [(100 + i, prose(100 + i, 40 + i), f"s{i % 3}") for i in range(40)]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(d, t, "en", s, len(t) if t is not None else None, *[None] * 10) for d, t, s in rows]
    return spark.createDataFrame([(*r, *(f"{name} of {r[0]}" for name in CLASHING)) for r in full], SCHEMA)


def labels(spark, rows=None):
    if rows is None:
        rows = [(100 + i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(40)] + [(1, 1, 0), (1, 1, 0), (None, 0, 1), (5, None, None)]
    return spark.createDataFrame(rows, LABELS)


def words_of(text):
    """The runs without ASCII white space."""
    return [w for w in (text or "").encode().split()]
