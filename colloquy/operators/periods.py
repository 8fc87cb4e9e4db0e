"""Report periods and recency windows, all in UTC. The clock is an argument everywhere."""

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UsageError

KINDS = ("daily", "weekly", "monthly", "last-30-days", "custom")


@dataclass(frozen=True)
class Period:
    kind: str
    start: date
    end: date

    def holds(self, started: Column) -> Column:
        """Whether a start lies within, both days included; false where it is unknown."""
        return F.coalesce(F.to_date(started).between(F.lit(self.start), F.lit(self.end)), F.lit(False))


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


def parse_day(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text or ""):
        raise UsageError(f"not a date of the form YYYY-MM-DD: {text}")
    try:
        return date.fromisoformat(text)
    except ValueError:
        raise UsageError(f"no such day: {text}") from None


def period(kind: str | None, now: datetime, start: str | None = None, end: str | None = None) -> Period:
    """A named period that ends today, or one from start to end, which must both be given."""
    today = now.astimezone(timezone.utc).date()
    if kind == "custom" or kind is None and (start or end):
        if not start or not end:
            raise UsageError("a custom period needs a first and a last day")
        first, last = parse_day(start), parse_day(end)
        if first > last:
            raise UsageError("a period's first day must not come after its last")
        return Period("custom", first, last)
    if kind is None:
        raise UsageError("a period is needed")
    if start or end:
        raise UsageError("a named period takes no days")
    first = {"daily": today, "weekly": today - timedelta(6), "monthly": today.replace(day=1), "last-30-days": today - timedelta(29)}.get(kind)
    if first is None:
        raise UsageError(f"no such period: {kind}")
    return Period(kind, first, today)


@dataclass(frozen=True)
class Recency:
    """Only what is as new as `cutoff` (UTC), or everything."""

    cutoff: datetime | None = None

    def holds(self, ts: Column) -> Column:
        """Unknown times pass."""
        return F.lit(True) if self.cutoff is None else F.coalesce(ts >= F.lit(self.cutoff), F.lit(True))


def recency(days: int | None, since: str | None, now: datetime) -> Recency:
    """The last N days, counted from today's midnight, or since a day; not both."""
    if days is not None and since is not None:
        raise UsageError("give either a number of days or a first day")
    if days is not None:
        if days < 1:
            raise UsageError("the number of days must be at least 1")
        midnight = now.astimezone(timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0)
        return Recency(midnight - timedelta(days))
    if since is not None:
        return Recency(datetime.combine(parse_day(since), datetime.min.time(), timezone.utc))
    return Recency()
