"""Days: the literal date at the start of an ISO date or RFC 3339 instant, never shifted by a zone."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))?$"
_EPOCH = datetime.date(1970, 1, 1)


def day_of(text: Column) -> Column:
    """Days since 1970-01-01; null for null and for anything else than a date."""
    return F.when(text.rlike(_ISO), F.unix_date(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))).cast("long")


def day(text: str) -> int | None:
    if not re.match(_ISO, text):
        return None
    try:
        return (datetime.date.fromisoformat(text[:10]) - _EPOCH).days
    except ValueError:
        return None


def today() -> int:
    return (datetime.datetime.now(datetime.UTC).date() - _EPOCH).days
