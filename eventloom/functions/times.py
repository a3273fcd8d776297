"""Timestamps of many providers as milliseconds since the epoch."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_text import let

RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
PLAIN = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d+)?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def rfc3339_ms(raw: Column) -> Column:
    """Milliseconds of an RFC 3339 text; null for anything else."""
    return F.when(raw.rlike(RFC3339), F.floor(F.unix_micros(F.try_to_timestamp(F.upper(raw))) / 1000))


def number_ms(value: Column) -> Column:
    """Seconds, or milliseconds where larger than 10^12, as whole milliseconds."""
    x = value.cast("double")
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(9.2e18))
    return F.when(usable, F.when(F.abs(x) > 1e12, F.round(x)).otherwise(F.round(x * 1000))).cast("long")


def provider_ms(raw: Column, fallback: Column | None = None) -> Column:
    """RFC 3339, then a plain UTC date and time, then a number, then ``fallback``."""

    def parsed(text: Column) -> Column:
        plain = F.when(text.rlike(PLAIN), F.floor(F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit("Z")))) / 1000))
        return F.coalesce(rfc3339_ms(text), plain, F.when(text.rlike(NUMBER), number_ms(text)))

    return F.coalesce(let(raw, parsed), F.lit(None).cast("long") if fallback is None else fallback)


def first_ms(*columns: Column) -> Column:
    return F.coalesce(*[provider_ms(c) for c in columns])


def utc_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def since_ms(text: str, now: datetime) -> int:
    """``Nd`` days before now, or an RFC 3339 instant, in milliseconds."""
    if m := re.fullmatch(r"(\d+)d", text.strip()):
        return int((now - timedelta(days=int(m[1]))).timestamp() * 1000)
    return instant_ms(text)


def instant_ms(text: str) -> int:
    """An RFC 3339 instant in whole milliseconds; finer ones are refused."""
    found = re.fullmatch(r"(.*?\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)", text.strip())
    if not found:
        raise ValueError(f"not an RFC 3339 instant: {text!r}")
    fraction = (found[2] or ".0")[1:]
    if fraction[3:].strip("0"):
        raise ValueError("instants must be whole milliseconds")
    zone = "+00:00" if found[3] in "Zz" else found[3]
    base = datetime.fromisoformat(found[1] + zone).astimezone(timezone.utc)
    return int(base.timestamp()) * 1000 + int(fraction[:3].ljust(3, "0"))
