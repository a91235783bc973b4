"""What several operators of this folder share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (null: empty); other columns, whatever their names, are left behind."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def py_remainder(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def row_hash(docs: DataFrame) -> Column:
    """Hash of all columns, whatever they are called."""
    return F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as ``docs`` has a column so named."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(docs: DataFrame, text_col: str, compute: Callable[[list], list[pa.Array]], names: list[str], kinds: list[str], rows: int = 512) -> DataFrame:
    """``docs``, whatever its columns are called, and the columns that ``compute`` makes of lists of up to ``rows`` texts (null: empty)."""
    at, old = docs.columns.index(text_col), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(old))])
    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"n{i}", T._parse_datatype_string(k)) for i, k in enumerate(kinds))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                new = compute([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema.names)

    return plain.mapInArrow(add, schema).toDF(*old, *names)
