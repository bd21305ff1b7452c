"""Time, size and rate formatting; all plain expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(seconds: Column) -> Column:
    return F.floor(seconds).cast("bigint")


def _pad2(x: Column) -> Column:
    """At least two digits; longer numbers are kept whole."""
    text = x.cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def hms(seconds: Column) -> Column:
    """``HH:MM:SS``; hours keep counting past a day."""
    s = _whole(seconds)
    return F.concat_ws(
        ":", _pad2(F.floor(s / 3600)), _pad2(F.floor(F.pmod(s, F.lit(3600)) / 60)), _pad2(F.pmod(s, F.lit(60)))
    )


def mmss(seconds: Column) -> Column:
    """``MM:SS``; minutes keep counting past an hour."""
    s = _whole(seconds)
    return F.concat_ws(":", _pad2(F.floor(s / 60)), _pad2(F.pmod(s, F.lit(60))))


def duration_text(seconds: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``3s``."""
    s = _whole(seconds)
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), _pad2(m), F.lit("m "), _pad2(r), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), _pad2(r), F.lit("s")))
        .otherwise(F.concat(r.cast("string"), F.lit("s")))
    )


def size_text(size_bytes: Column) -> Column:
    """Bytes as GB / MB / KB with one decimal, or plain B."""

    def scaled(unit: int, name: str) -> Column:
        # a size over a power of two prints ties to even, as a C printf does
        return F.concat(F.format_string("%.1f", F.bround(size_bytes / F.lit(float(unit)), 1)), F.lit(f" {name}"))

    return (
        F.when(size_bytes >= 1 << 30, scaled(1 << 30, "GB"))
        .when(size_bytes >= 1 << 20, scaled(1 << 20, "MB"))
        .when(size_bytes >= 1 << 10, scaled(1 << 10, "KB"))
        .otherwise(F.concat(size_bytes.cast("string"), F.lit(" B")))
    )


def parse_rate(rate: Column) -> Column:
    """``num/den`` or a plain number; a zero denominator falls back to the numerator."""
    parts = F.split(rate, "/")
    num = F.get(parts, F.lit(0)).try_cast("double")
    den = F.get(parts, F.lit(1)).try_cast("double")
    return F.when(den.isNotNull() & (den != 0), num / den).otherwise(num)


def is_variable_rate(real: Column, average: Column) -> Column:
    return F.coalesce(F.abs(parse_rate(real) - parse_rate(average)) > 0.5, F.lit(False))


def size_reduction(before: Column, after: Column) -> Column:
    """Percent saved; 0 for an empty original."""
    return F.when(before == 0, F.lit(0.0)).otherwise((1 - after / before) * 100)


def realtime_factor(duration: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, duration / elapsed).otherwise(F.lit(0.0))
