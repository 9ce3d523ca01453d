"""Language identification by prediction by partial matching.

One context tree a language holds, for every context of up to ``ORDER`` bytes, how often each byte followed. A byte that
the longest context has not seen escapes to the next shorter one (escape method C: distinct / (total + distinct)), down
to a uniform guess over bytes. Statistics are frozen after training, so the exact code length of every (context, byte) is
a number. The code length of a text is a sum of them, and the language with the shortest code wins.

Trees are sparse: only contexts of the training rows are held, so memory depends on the rows and not on the alphabet or
on the number of languages squared. Languages are held in groups of ``GROUP``; a group has one hash table an order, whose
rows give the code lengths of a (context, byte) in all its languages, with the escapes of those that have not seen it.
The order is the same for any number of languages. A-Z are read like a-z, digits alike, and white space alike; all other
bytes are themselves.

Training reads rows of about ``SAMPLE_BYTES`` a language, whole texts chosen by a hash of id and text: the documented
bound of the fit.

Defined cases: null text, and text without a letter, is ``und`` with score 0; without training rows all is ``und``;
null languages and null ids are not learned from; of equal code lengths the language first in the alphabet wins; repeated
rows are scored alike; empty tables give no rows; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common

SAMPLE_BYTES, ORDER, GROUP = 1_500_000, 4, 8
#: Bytes of evidence that the score is stated for: longer texts do not saturate it.
EVIDENCE = 24
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
PIECE = 1 << 16
FOLD = np.arange(256, dtype=np.int64)
FOLD[65:91] += 32
FOLD[48:58] = 48
FOLD[9:14] = 32
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(raw: bytes, order: int = ORDER) -> np.ndarray:
    """Each byte with the ``order`` bytes before it as one number; the first ``order`` bytes are context only."""
    x = FOLD[np.frombuffer(raw, np.uint8)]
    key = np.zeros(len(raw) - order, np.int64)
    for k in range(order + 1):
        key = key << 8 | x[k : k + len(key)]
    return key


class Numbers:
    """A hash table from numbers to their places in an array, for many numbers at a time."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.place = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of numbers that want one slot the last one gets it
            own = self.keys[at] == keys[left]
            self.place[at[own]] = left[own]
            at, left = (at[~own] + 1) & ((1 << self.bits) - 1), left[~own]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 for numbers that are not there."""
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.place[at], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there, wanted = self.keys[at[left]], keys[left]
            hit = there == wanted
            out[left[hit]] = self.place[at[left[hit]]]
            left = left[~hit & (there != -1)]
        return out


class Trees:
    """The frozen context trees of a group of languages."""

    def __init__(self, counted: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> None:
        """``counted``: grams and their counts for each language."""
        self.order = order
        self.pairs: list[tuple[Numbers, np.ndarray]] = []  # by order: (context, byte) and code lengths
        self.escapes: list[tuple[Numbers, np.ndarray]] = []  # by order: contexts and the cost of leaving them
        known, lower = np.empty(0, np.int64), np.empty((0, 0))
        for k in range(order + 1):
            mask = (1 << 8 * (k + 1)) - 1
            own = [self._summed(g & mask, n) for g, n in counted]
            union = np.unique(np.concatenate([np.arange(256) if k == 0 else np.empty(0, np.int64), *(g for g, _ in own)]))
            contexts = np.unique(union >> 8)
            bits, leave = np.empty((len(union), len(counted)), np.float32), np.zeros((len(contexts), len(counted)), np.float32)
            below = lower[np.searchsorted(known, union & (mask >> 8))] if k else np.full((len(union), len(counted)), 8.0)
            for c, (g, n) in enumerate(own):
                total, distinct = (np.bincount(np.searchsorted(contexts, g >> 8), w, len(contexts)) for w in (n, None))
                seen = total > 0
                leave[seen, c] = -np.log2(distinct[seen] / (total + distinct)[seen])
                at = np.searchsorted(contexts, union >> 8)
                bits[:, c] = leave[at, c] + below[:, c]
                mine = np.searchsorted(union, g)
                bits[mine, c] = -np.log2(n / (total + distinct)[at[mine]])
            self.pairs.append((Numbers(union), bits))
            self.escapes.append((Numbers(contexts), leave))
            known, lower = union, bits

    @staticmethod
    def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(keys, return_inverse=True)
        return found, np.bincount(at, n, len(found))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length of a run of grams in each language."""
        out = np.zeros(self.pairs[0][1].shape[1])
        for k in range(self.order, -1, -1):
            table, cost = self.pairs[k]
            at = table.find(keys)
            met = at >= 0
            out += cost[at[met]].sum(0, dtype=np.float64)
            keys = keys[~met]
            if not len(keys):
                break
            table, cost = self.escapes[k]
            at = table.find(keys >> 8)
            out += cost[at[at >= 0]].sum(0, dtype=np.float64)
            keys = keys & ((1 << 8 * k) - 1)
        return out


class Model:
    """Frozen statistics of all languages."""

    def __init__(self, languages: list[str], trees: list[Trees]) -> None:
        self.languages, self.trees = languages, trees

    def bits(self, raw: bytes) -> np.ndarray:
        """Code length of a text in each language."""
        total = np.zeros(len(self.languages))
        for at in range(0, len(raw), PIECE):  # pieces, with the context carried over: bounded memory for any length
            keys = grams(raw[at - ORDER : at + PIECE] if at else b" " * ORDER + raw[:PIECE])
            total += np.concatenate([t.bits(keys) for t in self.trees])
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        raw = text.encode("utf-8", "surrogatepass")
        bits = self.bits(raw)
        best = int(bits.argmin())
        scaled = (bits - bits[best]) * min(1.0, EVIDENCE / len(raw))
        return self.languages[best], float(1.0 / np.exp2(-scaled).sum())


def fit(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of languages with their grams and counts."""
    languages = sorted(counted)
    return Model(languages, [Trees([counted[x] for x in languages[at : at + GROUP]]) for at in range(0, len(languages), GROUP)])


def count(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of texts, each led by ``ORDER`` spaces, and how often they are there."""
    parts = [grams(b" " * ORDER + (t or "").encode("utf-8", "surrogatepass")) for t in texts]
    return np.unique(np.concatenate(parts), return_counts=True)


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from rows with a language. What comes to the driver is bounded by the number of grams, not of rows."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND id IS NOT NULL")
    totals = {r["lang"]: r["size"] or 0 for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    if not totals:
        return Model([], [])
    share = F.create_map(*[F.lit(x) for lang in totals for x in (lang, min(1.0, sample_bytes / max(1, totals[lang])))])
    chosen = rows.where(F.pmod(F.xxhash64("id", "text", F.lit("language")), F.lit(1 << 50)) / float(1 << 50) < share[F.col("lang")])

    def gram_counts():
        def work(columns):
            by: dict[str, list] = {}
            for lang, t in zip(columns["lang"], columns["text"]):
                by.setdefault(lang, []).append(t)
            found = [(lang, *count(texts)) for lang, texts in by.items()]
            return {"lang": [x for lang, g, _ in found for x in [lang] * len(g)], "gram": np.concatenate([np.empty(0, np.int64), *(g for _, g, _ in found)]), "n": np.concatenate([np.empty(0, np.int64), *(n for *_, n in found)])}

        return work

    found = common.map_rows(chosen.select("lang", "text"), "lang string, gram long, n long", gram_counts).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    code, values = pd.factorize(table.column("lang").to_pandas())
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    nothing = (np.empty(0, np.int64), np.empty(0, np.int64))
    return fit(dict.fromkeys(totals, nothing) | {lang: (gram[code == c], n[code == c]) for c, lang in enumerate(values)})


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred and score; existing columns of these names are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # its size depends on SAMPLE_BYTES a language
    kept = [f for f in df.schema if f.name.lower() not in ("lang_pred", "score")]

    def each():
        predict = sent.value.predict

        def work(columns):
            found = [predict(t) for t in columns[text_col]]
            return columns | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return work

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return common.map_rows(df, f"{schema}lang_pred string, score double", each)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
