"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tastemill.session import ensure_checkpoint_dir, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

# Texts are handled in blocks of about this many characters, at least one text each.
BLOCK_CHARS = 4_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``saved``, for large tables: compressed Parquet in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most_chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into blocks whose texts hold about ``most_chars`` bytes."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most_chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def map_text(
    df: DataFrame,
    columns: list[str],
    schema: T.StructType | str,
    make: Callable[[pa.RecordBatch], dict[str, object]],
    text: str = "text",
) -> DataFrame:
    """Apply ``make`` to blocks of the chosen columns; it returns the new columns."""
    out = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for block in blocks(batches, text):
            made = make(block)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)
