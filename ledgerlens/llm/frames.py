"""What the operators of this subpackage share: reading tables, walking Arrow batches, span lists."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.sources.tables import table

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256

Span = tuple[str, int, int]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_rows(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    """The rows of a batch as tuples, a slice at a time, so that long texts are not all unpacked at once."""
    for start in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(start, SLICE_ROWS)
        yield from zip(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in columns])


def map_rows(df: DataFrame, columns: list[str], schema: str | StructType, kernel: Callable[[tuple], tuple]) -> DataFrame:
    """Apply ``kernel`` to every row of the named columns. Rows keep their partition; nothing is shuffled."""
    chosen = df.select(*[F.col(f"`{c}`") for c in columns])
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = [f.name for f in target.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = [kernel(row) for row in text_rows(batch.slice(start, SLICE_ROWS), columns)]
                data = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(values), type=field.type) for values, field in zip(data, arrow)], schema=arrow
                )

    return chosen.mapInArrow(run, target)


def span_text(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by the order of the kinds, joined by commas."""
    order = {kind: i for i, kind in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offsets of a UTF-8 text as code point offsets; the text is walked once."""
    out: dict[int, int] = {}
    at = count = 0
    for offset in sorted(set(offsets)):
        count += len(data[at:offset].decode("utf-8"))
        at, out[offset] = offset, count
    return out


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underlines as it takes to differ from all columns; Spark does not tell cases apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(f"`{name}`") if has_column(df, name) else default


def keep_rows(df: DataFrame, columns: list[str], verdict: Callable[[tuple], bool]) -> DataFrame:
    """The rows whose named columns pass ``verdict``, with all columns as they are. Nothing is shuffled."""
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            passed = [bool(verdict(row)) for row in text_rows(batch, columns)]
            yield batch.filter(pa.array(passed, pa.bool_()))

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, df.schema)
