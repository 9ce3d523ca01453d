"""Text assembly: truncation, escaping, record lines, token estimates and fences, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for the cut-out middle; 23 characters.
SENTINEL = "\n...[middle omitted]...\n"[:23]


def truncate_middle(text: Column, most: int) -> Column:
    """``text`` cut to ``most`` characters by leaving out its middle; the first half is the shorter one."""
    rest = most - len(SENTINEL)
    head = rest // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(SENTINEL), F.right(text, F.lit(rest - head))))


def escape_untrusted(text: Column) -> Column:
    """Signs that could open markup, as literal escapes."""
    for sign, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def tokens(text: Column) -> Column:
    """A token estimate: a quarter of the UTF-8 bytes, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / F.lit(4))).cast("bigint")


def domain_time(time: Column) -> Column:
    """UTC to the minute, or the second or microsecond where needed."""
    has_micros = F.date_format(time, "SSSSSS") != "000000"
    has_seconds = F.date_format(time, "ss") != "00"
    minute = F.date_format(time, "yyyy-MM-dd'T'HH:mm")
    return F.concat(minute, F.when(has_micros, F.date_format(time, ":ss.SSSSSS")).when(has_seconds, F.date_format(time, ":ss")).otherwise(""), F.lit("Z"))


def record_line(identity: Column, time: Column, place: Column, key: Column, text: Column, tombstone: Column, most: int | None = None, score: Column | None = None) -> Column:
    """``[id=…] time | place | key k | score v | text``, without the parts that are null; tombstones read ``retracted``."""
    body = escape_untrusted(text if most is None else truncate_middle(text, most))
    return F.concat(F.lit("[id="), identity.cast("string"), F.lit("] "), F.concat_ws(" | ", domain_time(time), place, F.concat(F.lit("key "), key), *([] if score is None else [F.when(score.isNotNull(), F.format_string("score %.3f", score))]), F.when(tombstone, "retracted").otherwise(body)))


def fence(body: Column, label: str) -> Column:
    return F.concat(F.lit(f"<{label}>\n"), body, F.lit(f"\n</{label}>"))


def fence_overhead(label: str) -> int:
    """The tokens that a fence costs beside its body."""
    return -(-len(f"<{label}>\n\n</{label}>".encode()) // 4)
