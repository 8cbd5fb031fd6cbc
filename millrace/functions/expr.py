"""Column expressions shared by checks, encoders and scoring.

Everything here is a plain Column expression, so it stays inside whole-stage
code generation and lets Catalyst prune and push down.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "__missing__"
SECONDS_PER_DAY = 86400.0
SECONDS_PER_WEEK = 604800.0


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType)]


def null_if_nan(column: Column) -> Column:
    """NaN counts as missing, as SQL NULL does."""
    return F.when(~F.isnan(column), column)


def finite(column: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


def to_number(df: DataFrame, name: str) -> Column:
    """Lenient numeric coercion: text that is no number becomes NULL."""
    dtype = df.schema[name].dataType
    column = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return null_if_nan(column.cast("double"))
    if is_numeric(dtype):
        return column.cast("double")
    return null_if_nan(F.trim(column.cast("string")).try_cast("double"))


def is_missing(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def value_text(df: DataFrame, name: str) -> Column:
    """Text of a value; whole doubles print as ``150.0`` at any size, NULL stays NULL."""
    dtype = df.schema[name].dataType
    column = F.col(name)
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = column.cast("double")
        magnitude = F.abs(number)
        plain = F.rtrim(number.try_cast("decimal(38,22)").cast("string"), F.lit("0"))
        plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
        wide = ((magnitude >= 1e7) & (magnitude < 1e16)) | ((magnitude < 1e-3) & (magnitude >= 1e-4))
        return F.when(wide, plain).otherwise(null_if_nan(number).cast("string"))
    return column.cast("string")


def category(df: DataFrame, name: str) -> Column:
    """Text of a value with ``__missing__`` for NULL."""
    return F.coalesce(value_text(df, name), F.lit(MISSING))


def combined_category(df: DataFrame, names: Sequence[str]) -> Column:
    return F.concat_ws("_", *[category(df, n) for n in names])


def add_all(terms: Sequence[Column]) -> Column:
    """Sum as a balanced tree: hundreds of terms stay shallow, and compiled."""
    terms = list(terms)
    while len(terms) > 1:
        pairs = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = pairs + terms[len(pairs) * 2 :]
    return terms[0] if terms else F.lit(0)


def missing_features(df: DataFrame, prefixes: Sequence[str], columns: Sequence[str] | None = None) -> dict[str, Column]:
    """Missing count and ratio per row, over all columns and per name prefix."""
    columns = list(columns or df.columns)
    groups = [("missing_total", columns)]
    for prefix in prefixes:
        members = [c for c in columns if c.startswith(prefix)]
        if members:
            groups.append((f"{prefix}_missing", members))
    out: dict[str, Column] = {}
    for label, members in groups:
        count = add_all([is_missing(df, c).cast("int") for c in members])
        out[f"{label}_count"] = count
        out[f"{label}_ratio"] = count.cast("double") / F.lit(float(len(members)))
    return out


def amount_features(df: DataFrame, name: str) -> dict[str, Column]:
    """log1p of the non-negative amount, its cents (half-even) and a whole-amount flag."""
    amount = to_number(df, name)
    cents = F.pmod(F.rint(F.coalesce(amount, F.lit(0.0)) * 100), F.lit(100.0))
    return {
        f"{name}_log1p": F.when(amount.isNotNull(), F.log1p(F.greatest(amount, F.lit(0.0)))),
        f"{name}_cents": cents,
        f"{name}_is_round": (cents == 0).cast("int"),
    }


def time_features(df: DataFrame, name: str) -> dict[str, Column]:
    """Day, week, hour and weekday of a relative time in seconds, with cyclic pairs."""
    seconds = to_number(df, name)
    hour = F.pmod(F.floor(seconds / 3600.0).cast("double"), F.lit(24.0))
    weekday = F.pmod(F.floor(seconds / SECONDS_PER_DAY).cast("double"), F.lit(7.0))
    out = {
        f"{name}_day": seconds / SECONDS_PER_DAY,
        f"{name}_week": F.floor(seconds / SECONDS_PER_WEEK).cast("double"),
        f"{name}_hour": hour,
        f"{name}_weekday": weekday,
    }
    for label, value, period in (("hour", hour, 24), ("weekday", weekday, 7)):
        angle = value * F.lit(2 * math.pi / period)
        out[f"{name}_{label}_sin"] = F.sin(angle)
        out[f"{name}_{label}_cos"] = F.cos(angle)
    return out


def email_parts(df: DataFrame, name: str) -> dict[str, Column]:
    """Lower-cased domain root (before the first dot) and suffix (after the last)."""
    domain = F.lower(category(df, name))
    return {
        f"{name}_root": F.substring_index(domain, ".", 1),
        f"{name}_suffix": F.substring_index(domain, ".", -1),
    }


def email_match(df: DataFrame, payer: str, receiver: str) -> Column:
    left, right = F.lower(category(df, payer)), F.lower(category(df, receiver))
    return ((left == right) & (left != MISSING)).cast("int")


def group_ratio(amount: Column, median: Column) -> Column:
    """amount / median with a zero median or an infinite result as NULL."""
    return finite(F.try_divide(amount, F.when(median != 0, median)))


def parse_utc(name: str) -> Column:
    """ISO text to a UTC timestamp, NULL when it does not parse."""
    return F.try_to_timestamp(F.col(name).cast("string"))


def age_days(reference: Column, moment: Column) -> Column:
    return (F.unix_micros(reference) - F.unix_micros(moment)).cast("double") / F.lit(SECONDS_PER_DAY * 1e6)


def is_future(moment: Column, reference: Column, days: float) -> Column:
    return F.unix_micros(moment) > F.unix_micros(reference) + F.lit(int(days * SECONDS_PER_DAY * 1e6))


def check_payload(features: Column) -> dict[str, Column]:
    """Validate a feature map: trimmed keys, and the reason a row is to be rejected."""
    keys = F.map_keys(features)
    blank = F.exists(keys, lambda k: F.trim(k) == "")
    number = lambda v: v.try_cast("double")
    infinite = F.exists(F.map_values(features), lambda v: F.isnan(number(v)) | (F.abs(number(v)) == float("inf")))
    reason = (
        F.when(features.isNull() | (F.size(keys) == 0), "empty")
        .when(blank, "blank_name")
        .when(F.coalesce(infinite, F.lit(False)), "not_finite")
    )
    # Trimming may make two names equal: the later one wins, as in a dictionary.
    entries = F.transform(
        F.map_entries(features), lambda e: F.struct(F.trim(e["key"]).alias("key"), e["value"].alias("value"))
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.greatest(F.size(entries) - i - F.lit(1), F.lit(0))),
            lambda other: other["key"] == e["key"],
        ),
    )
    return {"features": F.when(reason.isNull(), F.map_from_entries(last)), "reject_reason": reason}


def seeded_hash(seed: int, *columns: str | Column) -> Column:
    """64-bit hash of a row key: the same on every run and for every partitioning."""
    return F.xxhash64(F.lit(int(seed)).cast("long"), *[F.col(c) if isinstance(c, str) else c for c in columns])


def hash_fraction(seed: int, *columns: str | Column) -> Column:
    """Uniform number in [0, 1) derived from the row key."""
    return F.shiftrightunsigned(seeded_hash(seed, *columns), 11).cast("double") / F.lit(float(2**53))


def details_map(values: Mapping[str, Column]) -> Column:
    """A string map, the shape of issue details."""
    pairs: list[Column] = []
    for key, value in values.items():
        pairs += [F.lit(key), value.cast("string")]
    return F.create_map(*pairs)
