"""Five-field cron expressions, for triggers by the clock. Buckets are minutes in UTC."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

#: Ranges of minute, hour, day, month and weekday (0 and 7 are Sunday).
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


class Cron:
    """Minutes at which a schedule is due. Day and weekday are joined by OR if both are restricted."""

    def __init__(self, expression: str) -> None:
        fields = expression.split()
        if len(fields) != 5:
            raise ValueError("a schedule has five fields")
        self.sets = [self._values(f, *r) for f, r in zip(fields, RANGES)]
        self.sets[4] = {x % 7 for x in self.sets[4]}
        self.any_day, self.any_weekday = fields[2].startswith("*"), fields[4].startswith("*")

    @staticmethod
    def _values(text: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            first, _, last = span.partition("-")
            a, b = (low, high) if span == "*" else (int(first), int(last) if last else (high if step else int(first)))
            if not low <= a <= b <= high or step and int(step) < 1:
                raise ValueError(f"{part} is out of range")
            out |= set(range(a, b + 1, int(step) if step else 1))
        return out

    def due(self, t: dt.datetime) -> bool:
        day, weekday = t.day in self.sets[2], t.isoweekday() % 7 in self.sets[4]
        on_day = day and weekday if self.any_day or self.any_weekday else day or weekday
        return t.minute in self.sets[0] and t.hour in self.sets[1] and t.month in self.sets[3] and on_day

    def buckets(self, after: dt.datetime, until: dt.datetime, most: int = 100) -> Iterator[dt.datetime]:
        """Due minutes in (after, until], the latest ``most``: what a scheduler catches up on."""
        t = until.replace(second=0, microsecond=0)
        found = []
        while t > after and len(found) < most:
            if self.due(t):
                found.append(t)
            t -= dt.timedelta(minutes=1)
        return iter(reversed(found))
