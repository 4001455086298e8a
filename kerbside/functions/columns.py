"""Column expressions: time, keys and numbers. All stay inside codegen."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.schemas import LOCAL_ZONE

# Fixed value: the NULL marker of the public surrogate-key convention.
NULL_KEY_TEXT = "_dbt_utils_surrogate_key_null_"

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}T"
KEY_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- time -------------------------------------------------------------------


def iso_timestamp(text: Column | str, strict: bool = False) -> Column:
    """ISO-8601 text to a timestamp, NULL where it is malformed.

    Offsets are normalised to UTC by the session zone. The lenient parser also
    takes a bare date or a bare time (filling in today); ``strict`` wants a
    full date and the ``T`` before it tries.
    """
    text = _col(text)
    parsed = F.try_to_timestamp(text)
    return F.when(text.rlike(ISO_SHAPE), parsed) if strict else parsed


def local_time(ts: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(_col(ts), zone)


def is_weekend(ts: Column | str) -> Column:
    """Saturday or Sunday, in the numbering where Sunday is 1."""
    return F.dayofweek(_col(ts)).isin(1, 7)


def iso_weekday(day: Column | str) -> Column:
    """Monday 1 to Sunday 7, the numbering of the date dimension only."""
    return F.weekday(_col(day)) + F.lit(1)


def iso_text(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end, truncated."""
    return F.timestamp_diff("SECOND", _col(start), _col(end))


def hour_index(day: Column | str, hour: Column | str) -> Column:
    """Hours since 1970-01-01 on the local wall clock."""
    return F.unix_date(_col(day)) * F.lit(24) + _col(hour)


def utc_hours_of_local_hour(day: Column, hour: Column, zone: str = LOCAL_ZONE) -> Column:
    """How many UTC hours share one local wall-clock hour: 2 when DST ends."""
    local = F.timestamp_add("HOUR", hour, day.cast("timestamp"))
    utc = F.to_utc_timestamp(local, zone)

    def same_local(hours: int) -> Column:
        shifted = F.from_utc_timestamp(F.timestamp_add("HOUR", F.lit(hours), utc), zone)
        return (shifted == local).cast("int")

    return F.lit(1) + same_local(1) + same_local(-1)


# --- keys -------------------------------------------------------------------


def key_text(value: Column | str, timestamp: bool = False) -> Column:
    value = _col(value)
    text = F.date_format(value, KEY_TIMESTAMP_FORMAT) if timestamp else value.cast("string")
    return F.coalesce(text, F.lit(NULL_KEY_TEXT))


def surrogate_key(*texts: Column) -> Column:
    """md5 over dash-joined key texts; build each with :func:`key_text`."""
    return F.md5(F.concat_ws("-", *texts))


def natural_key(location_id: Column | str, sensing_datetime: Column | str) -> Column:
    """``location_id#sensing_datetime``; NULL when either part is."""
    return F.concat(_col(location_id).cast("string"), F.lit("#"), _col(sensing_datetime))


# --- numbers ----------------------------------------------------------------


def zero_if_null(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(0))


def at_least(value: Column | str, bound: float) -> Column:
    """Clip from below; NULL stays NULL (``greatest`` alone would hide it)."""
    value = _col(value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(bound).cast("double")))


def cyclic(value: Column | str, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a circle of ``period`` steps."""
    angle = F.lit(2 * math.pi) * _col(value) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def whole_number(text: Column | str) -> Column:
    """Text to int, truncated toward zero; NULL where it is no number."""
    return F.trim(_col(text)).try_cast("double").try_cast("int")


# --- JSON values --------------------------------------------------------------

# White space around a quoted number, and decimal digits beyond ASCII with the
# digit each stands for.
_BLANK = r"[\s\x0B\x85\p{Z}]+"
_DIGITS = {
    chr(c): str(unicodedata.decimal(chr(c)))
    for c in range(0x80, 0x110000)
    if unicodedata.decimal(chr(c), None) is not None
}


def _text_as_whole(text: Column) -> Column:
    """Digits with an optional sign, blanks around and single underscores between
    them; no point and no exponent."""
    ascii_only = F.when(
        text.rlike(r"[^\x00-\x7F]"), F.translate(text, "".join(_DIGITS), "".join(_DIGITS.values()))
    ).otherwise(text)
    bare = F.regexp_replace(ascii_only, f"^{_BLANK}|{_BLANK}$", "")
    plain = text.try_cast("int")
    digits = F.when(bare.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(bare, F.lit("_"), F.lit("")))
    return F.when(text.rlike("^[0-9]+$"), plain).otherwise(digits.try_cast("int"))


def value_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def whole_value(value: Column, kind: Column) -> Column:
    """A JSON value (a variant) of a known kind as an int; NULL where it is none.

    Numbers are truncated toward zero and booleans count 1 and 0, but text must
    be a whole number as it stands: 3.7 is 3, "3" is 3, "3.7" is nothing. Nor are
    null, lists and objects, and numbers beyond 32 bits.
    """
    return (
        F.when(kind == "BIGINT", F.try_variant_get(value, "$", "int"))
        .when(kind == "STRING", _text_as_whole(F.try_variant_get(value, "$", "string")))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        .when(
            kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"),
            F.try_variant_get(value, "$", "double").try_cast("int"),
        )
    )


def is_empty_value(value: Column, kind: Column) -> Column:
    """Absent, null, false, or text, list or object without content."""
    return F.when(kind == "BIGINT", False).otherwise(
        value.isNull() | F.to_json(value).isin("null", "false", '""', "[]", "{}")
    )


def text_value(value: Column) -> Column:
    """A JSON value as text: strings as they are, null as NULL, others as JSON."""
    return F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")
    ).when(~F.is_variant_null(value), F.to_json(value))


def truncated_mean(mean: Column) -> Column:
    """Mean as a whole number, 0 where there is nothing to average."""
    return F.coalesce(mean, F.lit(0.0)).cast("int")
