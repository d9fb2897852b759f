"""Money, rates and other arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MONEY


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(text: Column | str) -> Column:
    """Exact decimal of a decimal text; text that is none fails the query."""
    return _c(text).cast(MONEY)


def total(amount: Column) -> Column:
    """Exact sum; nulls are left out and no rows give 0."""
    return F.coalesce(F.sum(amount.cast("decimal(28,12)")), F.lit(0)).cast(MONEY)


def usd(amount: Column | str) -> Column:
    """Plain decimal text without exponent or trailing zeros; `none` for null."""
    text = F.regexp_replace(F.regexp_replace(_c(amount).cast(MONEY).cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    text = F.when(text.isin("-0", ""), F.lit("0")).otherwise(text)
    return F.coalesce(text, F.lit("none"))


def is_price(text: Column | str) -> Column:
    return _c(text).rlike(r"^[0-9]+(\.[0-9]+)?$")


def invalid_rate(valid: Column, invalid: Column) -> Column:
    """invalid / (valid + invalid); null where both are 0."""
    return F.try_divide(invalid.cast("double"), (valid + invalid).cast("double"))


def pass_ratio(passed: Column, units: Column) -> Column:
    return F.coalesce(F.try_divide(passed.cast("double"), units.cast("double")), F.lit(0.0))


def likert(latent: Column, points: Column | int) -> Column:
    """1 to `points` from a latent in [0, 1)."""
    points = F.lit(points) if isinstance(points, int) else points
    return F.least(points, (F.floor(latent * points) + 1).cast("int"))


def encoded_bytes(size: Column, base64: Column | bool) -> Column:
    base64 = F.lit(base64) if isinstance(base64, bool) else base64
    return F.when(base64, F.lit(4) * F.floor((size + 2) / 3)).otherwise(size).cast("bigint")


def backoff(k: Column, first_s: float, most_s: float, jitter: Column) -> Column:
    """Seconds before retry k (from 1); jitter in [0, 1) takes off up to a half."""
    return F.least(F.lit(most_s), F.lit(first_s) * F.pow(F.lit(2.0), k - 1)) * (F.lit(0.5) + jitter / 2)


def frame_rate(fraction: Column | str) -> Column:
    """`30000/1001` or `25` as a number; null where there is none."""
    parts = F.split(_c(fraction), "/")
    top, bottom = F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1), F.lit("1")).try_cast("double")
    return F.try_divide(top, bottom)
