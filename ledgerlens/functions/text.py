"""Text search: an analyser, a query grammar, match counts, BM25 and cover density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import held, spread

#: Words that carry no meaning for search.
STOP_WORDS = frozenset("a an and are as at be but by for from had has have he her his i if in into is it its no not of on or our she so such that the their then there these they this to was we were what when which will with you your".split())
SUFFIXES = ("ational", "iveness", "fulness", "ization", "ations", "ingly", "ation", "ness", "ment", "ings", "edly", "ies", "ing", "ed", "es", "ly", "s")


def stem(word: str) -> str:
    """A light suffix stemmer."""
    for s in SUFFIXES:
        if word.endswith(s) and len(word) - len(s) >= 3:
            return word[: -len(s)] + ("y" if s == "ies" else "")
    return word


def terms(column: Column) -> Column:
    """Lower-cased runs of letters and digits, in the JVM."""
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hits(words: Column | str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def match_counts(rows: DataFrame, term: str, text: str = "text", identity: str = "id") -> DataFrame:
    """(id, hits) of rows that have the term."""
    hits = _hits(terms(F.col(text)), term.lower())
    return rows.select(identity, hits.alias("hits")).where("hits > 0")


def bm25(rows: DataFrame, query: str, text: str = "text", identity: str = "id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 of the query's terms. Texts are read once, into a narrow table of lengths and term counts."""
    wanted = sorted({w for w in re.findall(r"[^\W_]+", query.lower())})
    low = F.lower(F.col(text))
    words = spread(rows.select(identity, text)).select(identity, low.alias("low"), terms(F.col(text)).alias("w"))
    tf = [F.when(F.contains("low", F.lit(t)), _hits("w", t)).otherwise(0).alias(f"tf{i}") for i, t in enumerate(wanted)]
    counts = held(words.select(identity, F.size("w").alias("n"), *tf))
    stats = counts.agg(F.count("*").alias("rows_n"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("rows_n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(wanted))], F.lit(0), F.lit(0))
    return counts.where(hit > 0).crossJoin(F.broadcast(stats)).select(identity, score.alias("score"))  # one row of statistics


class Query:
    """Bare words are joined by AND; ``or``, ``-word`` and quoted phrases as usual."""

    def __init__(self, text: str) -> None:
        self.any_of: list[list[list[str]]] = [[]]
        self.none_of: list[list[str]] = []
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
            if word == "or":
                self.any_of.append([])
                continue
            parts = [stem(w) for w in re.findall(r"[^\W_]+", phrase or word) if w not in STOP_WORDS]
            if parts:
                (self.none_of if minus else self.any_of[-1]).append(parts)
        self.any_of = [g for g in self.any_of if g]

    def density(self, text: str) -> float:
        """Cover density: the sum over least covers of 1 / length; 0 without a match."""
        words = [stem(w) for w in re.findall(r"[^\W_]+", text.lower())]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            at.setdefault(w, []).append(i)
        found = lambda p: [i for i in at.get(p[0], []) if words[i : i + len(p)] == p]
        if any(found(p) for p in self.none_of):
            return 0.0
        best = 0.0
        for group in self.any_of:
            places = [(i, k) for k, p in enumerate(group) for i in found(p)]
            if len({k for _, k in places}) < len(group):
                continue
            places.sort()
            last: dict[int, int] = {}
            total, floor = 0.0, -1
            for i, k in places:
                last[k] = i
                if len(last) == len(group) and (low := min(last.values())) > floor:
                    total += 1 / (1 + math.log1p(i - low))
                    floor = low
            best = max(best, total)
        return best


def cover_density(rows: DataFrame, query: str, text: str = "text", identity: str = "id") -> DataFrame:
    """(id, score) of matching rows."""
    parsed = Query(query)
    kind = rows.schema[identity].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            score = part["t"].map(lambda t: parsed.density(t or ""))
            yield pd.DataFrame({identity: part[identity], "score": score})[score > 0]

    # a text can match only if it has the first letters of some wanted word: tested in the JVM, before Python sees a row
    stems = sorted({p[0][:3] for g in parsed.any_of for p in g})
    likely = rows.where(F.col(text).isNotNull())
    if stems:
        likely = likely.where(reduce(Column.__or__, [F.contains(F.lower(F.col(text)), F.lit(s)) for s in stems]))
    return likely.select(identity, F.col(text).alias("t")).mapInPandas(run, f"{identity} {kind}, score double")
