"""Cell keys that keep the equality of the compared values.

A cell becomes ``struct<tag, key>``. Two cells are equal exactly when their keys are equal; the tag
names the value's type and only matters where cells are sorted by type first.

Numbers (integers, booleans, floats, decimals) share one key space, so 1, 1.0 and true are equal.
Text '1' is not. NULL equals NULL. NaN equals nothing, itself included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One letter per type; the letters sort as the names of the value types do
# (none, bool, bytes, date, datetime, float, int, str).
TAGS = {"none": "a", "bool": "b", "bytes": "c", "date": "d", "datetime": "e", "float": "f", "int": "i", "str": "s"}

CELL = "struct<tag:string,key:string>"
_SPLITTER = 134217729.0  # 2**27 + 1, cuts a double into two halves of 26 bits
_EXACT = float(2**52)
_LONG = 9.2e18


def with_rounded(df: DataFrame, columns: list[str], ndigits: int = 3) -> DataFrame:
    """Replace double columns by their values rounded on the exact binary value, ties to even.

    ``F.round`` rounds the shortest decimal text of the double (1.0005 gives 1.001), the compared
    results are rounded on the binary value (1.0005 lies below the tie and gives 1.0). The product
    x * 10**ndigits is taken as an exact sum of two doubles, so no Python worker is needed. The
    steps are separate projections: each value is computed once, inside one generated stage.
    """
    if not 0 <= ndigits <= 11:
        raise ValueError("ndigits must be between 0 and 11")
    scale = F.lit(float(10**ndigits))

    def step(frame: DataFrame, make) -> DataFrame:
        return frame.select("*", *[column for i, name in enumerate(columns) for column in make(i, F.col(name))])

    def part(letter: str, i: int) -> Column:
        return F.col(f"_{letter}{i}")

    out = step(df, lambda i, x: [(x * scale).alias(f"_p{i}"), (x * F.lit(_SPLITTER)).alias(f"_s{i}")])
    out = step(out, lambda i, x: [(part("s", i) - (part("s", i) - x)).alias(f"_h{i}"), F.floor(part("p", i)).cast("double").alias(f"_b{i}")])
    out = step(
        out,
        lambda i, x: [
            ((part("h", i) * scale - part("p", i)) + (x - part("h", i)) * scale).alias(f"_e{i}"),
            (part("p", i) - part("b", i)).alias(f"_f{i}"),
        ],
    )

    def rounded(i: int, name: str) -> Column:
        tie = (part("e", i) > 0.0) | ((part("e", i) == 0.0) & (F.pmod(part("b", i), F.lit(2.0)) == 1.0))
        up = (part("f", i) > 0.5) | ((part("f", i) == 0.5) & tie)
        value = (part("b", i) + F.when(up, 1.0).otherwise(0.0)) / scale
        return F.when(F.abs(part("p", i)) < _EXACT, value).otherwise(F.col(name)).alias(name)

    place = {name: i for i, name in enumerate(columns)}
    return out.select(*[rounded(place[c], c) if c in place else F.col(f"`{c}`") for c in df.columns])


def _number_key(x: Column, ndigits: int) -> Column:
    whole = (x == F.floor(x).cast("double")) & (F.abs(x) < _LONG)
    decimal = F.rtrim(x.cast(T.DecimalType(38, max(ndigits, 1))).cast("string"), F.lit("0"))
    return (
        F.when(whole, x.cast("bigint").cast("string"))
        .when(F.abs(x) < 1e17, decimal)
        .otherwise(x.cast("string"))
    )


def _cell(value: Column, dtype: T.DataType, never_equal: Column, ndigits: int) -> Column:
    if isinstance(dtype, T.NullType):
        return F.struct(F.lit(TAGS["none"]).alias("tag"), F.lit("z").alias("key"))
    if isinstance(dtype, T.DoubleType):
        tag = "float"
        key = F.when(F.isnan(value), F.concat(F.lit("x"), never_equal)).otherwise(
            F.concat(F.lit("n"), _number_key(value, ndigits))
        )
    elif isinstance(dtype, T.BooleanType):
        tag, key = "bool", F.concat(F.lit("n"), value.cast("int").cast("string"))
    elif isinstance(dtype, T.IntegralType):
        tag, key = "int", F.concat(F.lit("n"), value.cast("string"))
    elif isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        tag, key = "str", F.concat(F.lit("s"), value)
    elif isinstance(dtype, T.DateType):
        tag, key = "date", F.concat(F.lit("d"), value.cast("string"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        tag, key = "datetime", F.concat(F.lit("t"), value.cast("string"))
    elif isinstance(dtype, T.BinaryType):
        tag, key = "bytes", F.concat(F.lit("b"), F.hex(value))
    else:
        raise TypeError(f"cells of type {dtype.simpleString()} cannot be compared")
    return F.struct(
        F.when(value.isNull(), TAGS["none"]).otherwise(TAGS[tag]).alias("tag"),
        F.when(value.isNull(), "z").otherwise(key).alias("key"),
    )


def with_cells(df: DataFrame, columns: list[str], identity: Column | None = None, ndigits: int = 3) -> DataFrame:
    """Replace value columns by their cells. ``identity`` is text unique to the row; a NaN takes it
    as its key, so that it equals nothing."""
    types = {field.name: field.dataType for field in df.schema.fields}
    floats = [c for c in columns if isinstance(types[c], (T.DoubleType, T.FloatType, T.DecimalType))]
    safe = {name: f"_v{i}" for i, name in enumerate(columns)}
    others = [c for c in df.columns if c not in safe]
    identity = F.lit("") if identity is None else identity
    typed = df.select(
        *[F.col(f"`{c}`") for c in others],
        identity.alias("_identity"),
        *[(F.col(f"`{c}`").cast("double") if c in floats else F.col(f"`{c}`")).alias(safe[c]) for c in columns],
    )
    rounded = with_rounded(typed, [safe[c] for c in floats], ndigits) if floats else typed
    cells = []
    for place, name in enumerate(columns):
        dtype = T.DoubleType() if name in floats else types[name]
        unique = F.concat_ws(":", "_identity", F.lit(str(place)))
        cells.append(_cell(F.col(safe[name]), dtype, unique, ndigits).alias(name))
    return rounded.select(*[F.col(f"`{c}`") for c in others], *cells)


def ordered_keys(cells: Column) -> Column:
    """The row as a tuple: column order matters."""
    return cells.getField("key")


def encoded_keys(cells: Column) -> Column:
    """The row sorted by type, then text: column order is free, int 1 and float 1.0 sort apart."""
    return F.sort_array(cells).getField("key")


def bag_keys(cells: Column) -> Column:
    """The row as a multiset of values."""
    return F.sort_array(cells.getField("key"))


def counted_keys(keys: Column) -> Column:
    """Give each key its occurrence number, so that set operations respect multiplicity."""

    def number(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda key, i: F.struct(key.alias("key"), (i - F.array_position(ordered, key) + F.lit(2)).cast("int").alias("ord")),
        )

    # most rows hold no key twice: their keys are all first ones
    once = F.transform(F.sort_array(keys), lambda key: F.struct(key.alias("key"), F.lit(1).alias("ord")))
    counted = F.transform(F.array(F.array_sort(keys)), number)[0]
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), once).otherwise(counted)
