"""What several operators of this package share: stored tables, text batches, held-out rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.session import fresh_path

#: Texts handed to a text function at a time; bounds what a Python worker holds.
DOCS_PER_CALL = 256


_held: dict[str, Any] = {}


def worker_memory(owner: str, make: Callable[[], Any]) -> Any:
    """What a Python worker remembers from task to task for ``owner``, made when first asked for.

    Workers outlive their tasks and stages, so only the last owner's memory is held: whoever asks next frees the others'.
    """
    if owner not in _held:
        release_memory()
        _held[owner] = make()
    return _held[owner]


def release_memory() -> None:
    """Free what earlier tasks of this worker remembered."""
    _held.clear()


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once into the shared folder and read back.

    The rows then survive a lost executor and are computed once, however often they are read.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if it is not installed for them."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the id and the text, a NULL text as the empty one; whatever else ``docs`` has is left behind."""
    return docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    )


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def map_texts(df: DataFrame, each: Callable[[list, list], dict[str, list]], schema: str) -> DataFrame:
    """Apply ``each(ids, texts)`` to small lists of rows of (doc_id, text); it returns the columns of ``schema``."""
    from pyspark.sql.types import StructType  # noqa: PLC0415
    from pyspark.sql.pandas.types import to_arrow_schema  # noqa: PLC0415

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_PER_CALL):
                part = batch.slice(at, DOCS_PER_CALL)
                columns = each(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, schema)
