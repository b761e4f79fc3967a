"""Search strings and time bounds, read on the driver into small values."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from palaver.functions.text import normalize


@dataclass(frozen=True)
class Literal:
    """A quoted text; any capital makes it case-sensitive."""

    text: str
    sensitive: bool

    @staticmethod
    def of(text: str) -> Literal:
        text = unicodedata.normalize("NFC", text)
        return Literal(text, any(c.isupper() for c in text))


@dataclass(frozen=True)
class Query:
    raw: str
    unquoted: str
    literals: tuple[Literal, ...] = ()
    words: tuple[str, ...] = field(default=())

    @property
    def is_empty(self) -> bool:
        return not self.literals and not self.unquoted.split()

    @property
    def is_quoted_only(self) -> bool:
        return bool(self.literals) and not self.unquoted.split()


def parse(text: str) -> Query:
    """Quotes toggle; blank quotes go; an open quote at the end counts. Terms with an underscore become literals."""
    parts = text.split('"')
    quoted = [Literal.of(p) for p in parts[1::2] if p.strip()]
    unquoted = "".join(parts[0::2]).strip()
    terms = unquoted.split()
    names = [Literal.of(t) for t in terms if "_" in t]
    words = normalize(" ".join(t for t in terms if "_" not in t)).split()
    return Query(text, unquoted, tuple(quoted + names), tuple(words))


_SPAN = re.compile(r"(\d+)\s*(mo|months?|m|min|minutes?|h|hours?|d|days?|w|weeks?|y|years?|s|seconds?)$")
_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


@dataclass(frozen=True)
class TimePoint:
    """An instant with the length of the unit it was written in."""

    start: datetime
    unit: str

    def end(self) -> datetime:
        """First instant after the written unit."""
        if self.unit == "year":
            return self.start.replace(year=self.start.year + 1)
        if self.unit == "month":
            return shift_months(self.start, 1)
        return self.start + {"day": timedelta(days=1), "hour": timedelta(hours=1), "minute": timedelta(minutes=1), "second": timedelta(seconds=1)}.get(self.unit, timedelta(microseconds=1))


def shift_months(at: datetime, months: int) -> datetime:
    """Calendar months on; days past a month's end become its last day."""
    index = at.year * 12 + at.month - 1 + months
    year, month = divmod(index, 12)
    for day in range(at.day, 27, -1):
        try:
            return at.replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    return at.replace(year=year, month=month + 1)


def time_point(text: str, now: datetime) -> TimePoint:
    """``3d``, ``2mo``, ``2024``, ``2024-05``, ``2024-05-01``, ``2024-05-01T10:00`` ..., in UTC."""
    text = text.strip()
    if found := _SPAN.match(text):
        n, unit = int(found[1]), found[2]
        if unit.startswith("mo"):
            return TimePoint(shift_months(now, -n), "instant")
        if unit.startswith("y"):
            return TimePoint(shift_months(now, -12 * n), "instant")
        return TimePoint(now - timedelta(seconds=n * _SECONDS[unit[0]]), "instant")
    for form, unit in (("%Y", "year"), ("%Y-%m", "month"), ("%Y-%m-%d", "day"), ("%Y-%m-%dT%H", "hour"), ("%Y-%m-%dT%H:%M", "minute"), ("%Y-%m-%d %H:%M", "minute"), ("%Y-%m-%dT%H:%M:%S", "second"), ("%Y-%m-%d %H:%M:%S", "second")):
        try:
            return TimePoint(datetime.strptime(text.removesuffix("Z"), form).replace(tzinfo=timezone.utc), unit)
        except ValueError:
            continue
    raise ValueError(f"not a time: {text!r}")


def in_zone(local: datetime, zone: str, upper: bool) -> datetime:
    """The instant of a wall-clock time. A time that comes twice is the earlier one as a lower bound and the later one as an
    upper bound; one that never comes is an error."""
    place = ZoneInfo(zone)
    wall = local.replace(tzinfo=None)
    first, second = (wall.replace(tzinfo=place, fold=k).astimezone(timezone.utc) for k in (0, 1))
    if first.astimezone(place).replace(tzinfo=None) != wall:
        raise ValueError(f"there is no {wall} in {zone}: the clock goes past it")
    return second if upper else first


def time_range(after: str | None, before: str | None, now: datetime, zone: str = "UTC") -> tuple[datetime | None, datetime | None]:
    """[from, to): written times are those of ``zone``; the upper bound reaches to the end of the unit it is written in; an
    inverted range is an error."""

    def bound(text: str, upper: bool) -> datetime:
        point = time_point(text, now)
        if point.unit == "instant":
            return point.end() if upper else point.start
        if not upper:
            return in_zone(point.start, zone, False)
        return in_zone(point.end() - timedelta(microseconds=1), zone, True) + timedelta(microseconds=1)

    low = bound(after, False) if after else None
    high = bound(before, True) if before else None
    if low and high and low >= high:
        raise ValueError("the time range is inverted")
    return low, high
