"""Scalar column expressions: coercion, time, ratios, thresholds, text labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text forms read as true / false.
TRUE_TEXT = ("true", "1", "yes", "si", "sí")
FALSE_TEXT = ("false", "0", "no", "n")

# Commercial capacity steps in Mbps.
CAPACITY_STEPS = (
    10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600,
    800, 1000, 1500, 2000, 3000, 5000, 10000, 20000,
)

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NUMERIC_TYPES = (T.NumericType,)


def finite(c: Column) -> Column:
    """NaN and infinities become null, so no aggregate ever meets them."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a finite number becomes null."""
    text = c.cast("string")
    return finite(F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double")))


def number_of(df: DataFrame, name: str) -> Column:
    """``name`` as a double, parsing only when the column is not numeric yet."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return finite(F.col(name))
    return to_number(F.col(name))


def to_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_TEXT), F.lit(False))


def to_timestamp(c: Column, kind: str = "timestamp_ntz") -> Column:
    """ISO text (``T`` or blank, optional zone) to a timestamp; bad text is null."""
    return F.trim(c.cast("string")).try_cast(kind)


def status_ok(df: DataFrame) -> Column:
    """Row validity: ``sample_ok`` if present, else ``sample_status``, else true."""
    if "sample_ok" in df.columns:
        return to_bool(F.col("sample_ok"))
    if "sample_status" in df.columns:
        return F.coalesce(F.lower(F.col("sample_status").cast("string")) == "ok", F.lit(False))
    return F.lit(True)


# --- time ------------------------------------------------------------------

def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def epoch(ntz: bool) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") if ntz else F.timestamp_seconds(F.lit(0))


def micros(c: Column, ntz: bool) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch(ntz), c)


def as_instant(c: Column) -> Column:
    """A wall-clock timestamp read as UTC; watermarks need an instant."""
    return F.timestamp_micros(micros(c, True))


def as_wall_clock(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch(True))


def time_floor(c: Column, seconds: int, ntz: bool) -> Column:
    """Floor to an epoch-aligned bucket of ``seconds``."""
    us = micros(c, ntz)
    return F.timestamp_add("MICROSECOND", us - F.pmod(us, F.lit(int(seconds) * 1_000_000)), epoch(ntz))


def bucket_of(df: DataFrame, seconds: int, name: str = "timestamp") -> Column:
    return time_floor(F.col(name), seconds, is_ntz(df, name))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def add_seconds(c: Column, seconds: float) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(int(seconds * 1_000_000)), c)


# --- ratios and thresholds -------------------------------------------------

def ratio_pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100.0)


def loss_pct(sent: Column, received: Column) -> Column:
    """Share of packets that did not come back; null without packets."""
    return F.when(received.isNotNull() & (sent > 0),
                  F.greatest(sent - received, F.lit(0)) / sent * 100.0)


def pct_delta(value: Column, base: Column) -> Column:
    return F.when(base != 0, (value - base) / base * 100.0)


def baseline_threshold(base: Column, *, ratio: float, delta: float, floor: float = 0.0) -> Column:
    known = F.greatest(F.lit(float(floor)), base * ratio, base + delta)
    return F.when(base.isNull(), F.lit(float(max(floor, delta)))).otherwise(known)


def capacity_step(required: Column) -> Column:
    """Smallest commercial step that covers ``required``; whole Gbps above the ladder."""
    expr = F.when(required.isNull() | (required <= 0), 0.0)
    for step in CAPACITY_STEPS:
        expr = expr.when(required <= step, float(step))
    return expr.otherwise(F.ceil(required / 1000.0) * 1000.0).cast("double")


def is_close(a: Column, b: Column, rel_tol: float, abs_tol: float) -> Column:
    bound = F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel_tol, F.lit(float(abs_tol)))
    return (a == b) | (F.abs(a - b) <= bound)


# --- text ------------------------------------------------------------------

def not_available(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("N/D"))


def numbered(prefix: str, n: Column) -> Column:
    """``PREFIX-001``: three digits at least, more when needed."""
    return F.format_string(f"{prefix}-%03d", n.cast("long"))


def rank_in(c: Column, ordered: tuple[str, ...]) -> Column:
    expr = F.when(c == ordered[0], 0)
    for position, value in enumerate(ordered[1:], start=1):
        expr = expr.when(c == value, position)
    return expr.otherwise(len(ordered))


def flag_list(pairs: list[tuple[Column, str]]) -> Column:
    """Names whose condition holds, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs])))


def shown(c: Column, digits: int) -> Column:
    """A number as text with fixed digits, half up; what lies beyond nine decimals is arithmetic noise."""
    return F.round(F.round(c, 9).cast("decimal(28,9)"), digits).cast(f"decimal(20,{digits})").cast("string")


# For comparisons only: measured decimals often sit exactly on a rounding border; a fixed nudge far
# below the compared digits makes the last one independent of summation order.
NUDGE = 2e-10


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded doubles and text dates, for the comparison of whole tables."""
    def plain(f):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.round(F.col(f.name) + F.lit(NUDGE if digits == 6 else 0.0), digits).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.col(f.name).cast("string").alias(f.name)
        return F.col(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])
