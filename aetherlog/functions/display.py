"""Scalars behind the read screens: bands, labels, countdowns, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _band(c: Column, high: float, mid: float, names: tuple[str, str, str]) -> Column:
    return F.when(c >= high, names[0]).when(c >= mid, names[1]).otherwise(names[2])


def seconds_between(a: str | Column, b: str | Column) -> Column:
    """Seconds from ``a`` to ``b`` as DOUBLE, exact to the microsecond."""
    return (micros(b) - micros(a)) / F.lit(1e6)


def micros(ts: str | Column) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def round1(c: str | Column) -> Column:
    return F.round(_c(c), 1)


def round3(c: str | Column) -> Column:
    return F.round(_c(c), 3)


def meter_pct(rms: str | Column) -> Column:
    return F.least(F.lit(100.0), _c(rms) / 10000.0 * 100.0)


def meter_band(pct: str | Column) -> Column:
    return _band(_c(pct), 70, 30, ("high", "mid", "low"))


def rtf_band(rtf: str | Column) -> Column:
    rtf = _c(rtf)
    return F.when(rtf > 0, F.when(rtf < 0.5, "good").when(rtf < 1.0, "warn").otherwise("bad"))


def elevation_band(deg: str | Column) -> Column:
    return _band(_c(deg), 60, 40, ("high", "mid", "low"))


def minutes(duration_s: str | Column) -> Column:
    return F.round(_c(duration_s) / 60.0).cast("bigint")


def countdown(aos: str | Column, as_of: str | Column) -> Column:
    """``[Hh ]MM:SS`` until ``aos``, ``NOW`` once it has come, dashes without a pass."""
    left = F.floor((micros(aos) - micros(as_of)) / F.lit(1000000)).cast("bigint")
    hours = F.floor(left / 3600).cast("bigint")
    mmss = F.concat_ws(
        ":",
        F.lpad((F.floor(left / 60) % 60).cast("string"), 2, "0"),
        F.lpad((left % 60).cast("string"), 2, "0"),
    )
    return (
        F.when(left.isNull(), "--:--:--")
        .when(left <= 0, "NOW")
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), mmss))
        .otherwise(mmss)
    )


def progress_pct(start: str | Column, duration_s: str | Column, as_of: str | Column) -> Column:
    return F.least(F.lit(100.0), seconds_between(start, as_of) / _c(duration_s) * 100.0)


def relative_time(ts: str | Column, as_of: str | Column) -> Column:
    s = F.floor((micros(as_of) - micros(ts)) / F.lit(1000000)).cast("bigint")
    m = F.floor(s / 60).cast("bigint")
    return (
        F.when(s.isNull(), "never")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
        .when(m < 60, F.concat(m.cast("string"), F.lit(" min ago")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h ago")))
    )


def minutes_until(aos: str | Column, as_of: str | Column) -> Column:
    return F.round(seconds_between(as_of, aos) / 60.0, 1)


def alert_class(kind: str | Column) -> Column:
    kind = _c(kind)
    return (
        F.when(kind == "warning", "alert-warning")
        .when(kind == "watch", "alert-watch")
        .otherwise("alert-advisory")
    )


def pass_key(satellite: str | Column, aos: str | Column) -> Column:
    return F.concat_ws("_", _c(satellite), F.date_format(_c(aos), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def backend_label(backend: str | Column) -> Column:
    backend = _c(backend)
    return F.when(backend == "hailo", "Hailo NPU").when(backend == "cpu", "CPU").otherwise("None")


def safe_name(satellite: str | Column) -> Column:
    return F.translate(_c(satellite), " ", "-")


def to_event_json(*cols: str | Column) -> Column:
    """One JSON object from columns; NULL fields are left out."""
    return F.to_json(F.struct(*cols))


def from_event_json(c: str | Column, schema: str) -> Column:
    """Parse JSON with a declared schema; malformed text gives NULL fields."""
    return F.from_json(_c(c), schema)
