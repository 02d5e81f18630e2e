"""Column forms of the expressions that are applied to single columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estatelake.functions import sqltext as X


def strip(c: Column) -> Column:
    """Trim any Unicode white space at both ends."""
    return F.btrim(c, F.lit(X.WHITE_SPACE))


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities; other numbers as double."""
    d = c.cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def ratio(a: Column, b: Column) -> Column:
    """a/b, NULL for a zero or missing divisor or a non-finite result."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed 24-hour days, rounded down."""
    day = 86_400_000_000
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    # floor division on integers: pmod keeps the remainder non-negative
    return ((micros - F.pmod(micros, F.lit(day))) / F.lit(day)).cast("bigint")


def plain_label(c: Column) -> Column:
    """Lower case, ``_`` and ``-`` as blanks, single blanks; empty is NULL."""
    blanks = F.translate(F.lower(c), "_-" + X.WHITE_SPACE, " " * (2 + len(X.WHITE_SPACE)))
    text = F.regexp_replace(F.trim(blanks), " +", " ")
    return F.when(text != "", text)


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Bucket 0..buckets-1 from the md5 of a key: the same for any partitioning."""
    prefix = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.pmod(F.conv(prefix, 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def dtype_of(df, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def number_of(df, name: str) -> Column:
    """A column as finite double, NULL where it holds no number."""
    return F.expr(X.number(X.name(name), dtype_of(df, name)))
