"""Column expressions that everything else uses: seeded hashes, missing values, kinds of columns, number texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: Text that counts as a number: sign, digits, fraction, exponent, or infinity.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"


def h32(seed, *keys) -> Column:
    """Pseudo-random number in [0, 2^32) from a seed and keys (integers or text), the same wherever it is computed."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in (seed, *keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def is_na(x: Column, is_number: bool) -> Column:
    return (x.isNull() | F.isnan(x)) if is_number else x.isNull()


def is_missing(x: Column) -> Column:
    """Null, NaN or infinite."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def finite(x: Column) -> Column:
    return F.when(~is_missing(x), x)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMBERS)


def is_date_like(kind: T.DataType) -> bool:
    return isinstance(kind, (*DATES, T.DayTimeIntervalType))


def feature_kind(kind: T.DataType, decimal_as_number: bool = False) -> str | None:
    """number, date or text; None where a column gives no feature."""
    if is_numeric(kind) or (decimal_as_number and isinstance(kind, T.DecimalType)):
        return "number"
    if isinstance(kind, DATES):
        return "date"
    return None if isinstance(kind, T.BinaryType) else "text"


def number_text(x: Column) -> Column:
    """The number that a text stands for; null if it stands for none."""
    plain = F.lower(F.trim(x))
    inf = F.when(plain.rlike("^-inf"), float("-inf")).when(plain.rlike(r"^\+?inf"), float("inf"))
    return F.when(x.rlike(NUMBER_TEXT), F.coalesce(inf, plain.try_cast("double")))


def time_to_seconds(x: Column) -> Column:
    """Seconds of the day of 'HH:mm:ss[.f]'; null otherwise."""
    parts = F.split(x, ":")
    return F.when(x.rlike(r"^\d{1,2}:\d{2}:\d{2}(\.\d+)?$"), parts[0].cast("double") * 3600 + parts[1].cast("double") * 60 + parts[2].cast("double"))


@F.pandas_udf(T.StringType())
def _four_digits(x: pd.Series) -> pd.Series:
    ok = x.notna() & (x.abs() != float("inf"))
    return pd.Series([("%.4g" % (v + 0.0 if v else 0.0)) if good else "" for v, good in zip(x, ok, strict=True)], dtype=object)


def fmt_num(x: Column) -> Column:
    """Four significant digits as C's %.4g writes them; empty for what is missing. No built-in function writes this form."""
    return _four_digits(x.cast("double"))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
