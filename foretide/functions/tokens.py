"""Canonical value tokens, times in microseconds, bins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "__NULL__"
MISSING_BIN = "__CONTINUOUS_MISSING__"  # the category of missing numbers
DAY = 86_400_000_000


def micros(column: str) -> Column:
    """A time-zone-free timestamp as microseconds since 1970."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{column}` as timestamp_ntz))")


def days(later: Column, earlier: Column) -> Column:
    return (later - earlier) / float(DAY)


def plain(number: Column) -> Column:
    """A number's text without an exponent: digits are moved, none are lost or rounded."""
    parts = F.split(number, "E")
    sign, power = F.when(number.startswith("-"), "-").otherwise(""), F.element_at(parts, 2).cast("int")
    whole = F.regexp_replace(F.element_at(parts, 1), r"^-|\..*$", "")
    rest = F.regexp_replace(F.regexp_extract(F.element_at(parts, 1), r"\.(.*)$", 1), "0+$", "")
    digits, point = F.concat(whole, rest), F.length(whole) + power
    size = F.length(digits)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - size))
    between = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size))
    moved = F.when(point <= 0, small).when(point >= size, large).otherwise(between)
    return F.when(number.contains("E"), F.concat(sign, moved)).otherwise(number)


def token(df: DataFrame, column: str) -> Column:
    """n:, s: or b: by the column's type; null and NaN are NULL.  The same on fit and lookup."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.BooleanType):
        out = F.concat(F.lit("b:"), c.cast("int").cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        out = F.when(F.isnan(c), None).when(c == float("inf"), "n:+inf").when(c == float("-inf"), "n:-inf").when(whole, F.concat(F.lit("n:"), c.cast("long").cast("string"))).otherwise(F.concat(F.lit("n:"), plain(c.cast("string"))))
    elif isinstance(kind, T.DecimalType):
        text = c.cast("string")
        out = F.concat(F.lit("n:"), F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text))
    elif isinstance(kind, T.NumericType):
        out = F.concat(F.lit("n:"), c.cast("string"))
    elif isinstance(kind, T.ArrayType):
        out = F.array_join(F.transform(c, lambda x: x.cast("string")), "|", NULL)
    else:
        out = F.concat(F.lit("s:"), c.cast("string"))
    return F.coalesce(out, F.lit(NULL))


def composite(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws("|", *(token(df, c) for c in columns))


def quantile_bounds(df: DataFrame, column: str, bins: int) -> list[float]:
    """Interior quantiles (linear interpolation), distinct and strictly inside the range."""
    x = F.col(column).cast("double")
    r = df.agg(F.percentile(x, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    return [] if r.q is None else sorted({q for q in r.q if r.lo < q < r.hi})


def bin_label(column: Column, bounds: list[float]) -> Column:
    """bin_i, i being the number of bounds at or below the value."""
    i = sum((F.when(column >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return F.when(column.isNull() | F.isnan(column.cast("double")), MISSING_BIN).otherwise(F.concat(F.lit("bin_"), i.cast("string")))
