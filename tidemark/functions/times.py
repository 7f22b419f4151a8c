"""Time columns. Every instant is a BIGINT of UTC epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SAMPLE_RATE = 16_000
# Fixed value: the strict wire form of an instant.
ISO_MS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_to_ms(ts: Column | str) -> Column:
    """Zone-less timestamp, read as UTC, to epoch ms (floor)."""
    return F.unix_millis(col(ts).cast("timestamp"))


def iso_to_ms(text: Column | str) -> Column:
    """Strict `2026-09-26T10:15:32.417Z`; anything else, calendar errors included, is NULL."""
    c = col(text)
    return F.when(c.rlike(ISO_MS), F.unix_millis(F.try_to_timestamp(c)))


def ms_to_iso(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ms_to_compact(ms: Column | str) -> Column:
    """`20260926T101532417Z`, the form used in ids and file names."""
    return F.date_format(F.timestamp_millis(col(ms)), "yyyyMMdd'T'HHmmssSSS'Z'")


def ms_to_hms(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "HH:mm:ss")


def user_time_ms(text: Column | str) -> Column:
    """Lenient filter time: epoch ms digits, a date, or ISO with `Z`, an offset or no zone (UTC)."""
    c = F.trim(col(text))
    return F.when(c.rlike(r"^\d+$"), c.try_cast("bigint")).otherwise(F.unix_millis(F.try_to_timestamp(c)))


def ns_to_iso(ns: Column | str) -> Column:
    """Nanoseconds to ISO ms, rounding half up."""
    return ms_to_iso(floor_div(col(ns) + 500_000, 1_000_000))


def floor_div(a: Column | str, n: int) -> Column:
    """Integer floor division by a positive constant (exact on longs)."""
    a = col(a)
    step = F.lit(n).cast("bigint")
    return F.call_function("div", a - F.pmod(a, step), step)


def samples_to_ms(n: Column | str, rate: int = SAMPLE_RATE) -> Column:
    """Sample count to ms, half up."""
    return floor_div(col(n) * 1000 + rate // 2, rate)


def samples_to_ms_floor(n: Column | str, rate: int = SAMPLE_RATE) -> Column:
    return floor_div(col(n) * 1000, rate)


def session_id(device: Column | str, start_ms: Column | str) -> Column:
    return F.concat_ws("_", col(device), ms_to_compact(start_ms))


def archive_path(start_ms: Column | str, sha256: Column | str, prefix: Column | str = "") -> Column:
    """`<prefix>YYYY/MM/DD/<compact>_<sha8>.opus`."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    day = F.date_format(F.timestamp_millis(col(start_ms)), "yyyy/MM/dd")
    return F.concat(head, day, F.lit("/"), ms_to_compact(start_ms), F.lit("_"),
                    F.substring(col(sha256), 1, 8), F.lit(".opus"))


def local_date(ms: Column | str, tz: str) -> Column:
    """Calendar date of an instant in an IANA zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(col(ms)), tz))


def local_midnight_ms(date: Column | str, tz: str) -> Column:
    """Instant of a date's local midnight (the first instant after it where midnight is skipped)."""
    return F.unix_millis(F.to_utc_timestamp(col(date).cast("timestamp"), tz))


def week_start(date: Column | str) -> Column:
    """Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", col(date)))
