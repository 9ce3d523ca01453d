"""Substring deduplication with repeated-phrase automata.

A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller id.

1. Phrases: a window's anchor is the phrase of ``PHRASE`` words in it with the least hash (a minimiser). Neighbouring
   windows with the same anchor form a span of at most 88 words. Equal windows have equal anchors, so a window can recur
   only around an anchor that is in two documents; only spans of such anchors go on.
2. Recurring passages: equal spans are one class, with its smallest document. Where all spans of an anchor are equal, the
   whole span recurs. Where they differ (the borders of a passage, a phrase in many contexts), one document of each class
   gives its windows, and windows that are in two classes tell which part recurs, and where it is first.
3. Automata: documents are dealt into shards of about ``SHARD_BYTES`` by a hash. A shard gets the passages that may be in
   one of its documents, cut from the texts of the first documents, each once. Passages are cut into blocks of half a
   window, so that every window of a passage holds a whole block; these blocks make the shard's Aho-Corasick automaton.
   A word is written as a few letters, the same number for all words of a shard, so a block is a short string.
4. Streaming: every document passes through the automaton of its shard, whole and once. Where a block occurs, words are
   compared with the passage to both sides; a run of ``WINDOW`` equal words or more, in a passage of a smaller document,
   is an occurrence, and its words go.

Hashes only choose which passages a shard gets; what is removed is decided by the automaton's hits and by comparing
words, so two texts with one hash are never taken for each other. The 64-bit hashes can hide a repeat only if two
different recurring windows share one.

A hot passage is one row a shard; a document's text is sent once, whatever it shares with others; classes are
pre-aggregated in tasks. Defined cases: null and empty texts have no words; fewer than ``WINDOW`` words lose nothing;
rows that share an id are judged one by one against smaller ids, never against each other; rows with a null id lose
nothing and no row loses words for them; passages that repeat within one document stay; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common

WINDOW, PHRASE, SHARD_BYTES = 50, 12, 16 << 20
#: Words of a document that are in none of a shard's passages are written in this letter, which no passage has.
OTHER = "\x01"


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def anchor_of_windows(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words the place of the least phrase in it, the last one of equals; and the phrases' hashes.

    Hashes are compared without their 6 lowest bits, which hold places while minima are taken.
    """
    x = common.rolled(hashes, phrase)
    width = window - phrase + 1
    n = len(x) - width + 1
    # sliding minimum by blocks: least to the left and least to the right of block borders
    low = np.uint64(63)
    later = (width - 1 - np.arange(len(x)) % width).astype(np.uint64)  # less for later places in a block
    padded = np.concatenate([(x & ~low) | later, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()[width - 1 : width - 1 + n]
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()[:n]
    right = (ahead & ~low) <= (behind & ~low)
    block = np.where(right, np.arange(width - 1, width - 1 + n), np.arange(n)) // width
    return block * width + (width - 1 - (np.where(right, ahead, behind) & low).astype(np.int64)), x


def spans(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, span, start, windows) of the different spans of a document, from the hashes of its ``WINDOW`` words or more."""
    place, phrases = anchor_of_windows(h)
    windows = common.rolled(h, WINDOW)
    start = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    n = np.diff(np.concatenate([start, [len(place)]]))
    with np.errstate(over="ignore"):  # the first and the last window of a span hold all its words
        span = common.mix(common.mix(windows[start] * common.MULTIPLIER + windows[start + n - 1]) + n.astype(np.uint64))
    _, first = np.unique(span, return_index=True)
    return phrases[place[start[first]]].view(np.int64), span[first].view(np.int64), start[first], n[first]


def sharded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, text in UTF-8, shard) of every row, and the number of shards. Ids and texts decide, so equal ids are spread."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(common.partitions(df.sparkSession), -(-size // SHARD_BYTES))
    return docs.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")), shards


def wanted_passages(docs: DataFrame) -> DataFrame:
    """(shard, source, ranges): the word ranges of documents that may recur in a shard's documents with larger ids.

    ``docs`` has id, text and shard. Each step is a written table; what is no longer read is deleted.
    """

    def find():
        def work(columns: dict[str, list]) -> dict[str, list]:
            own, found = [], []
            for k, text in enumerate(columns["text"]):
                h = common.word_hashes(text)
                if len(h) >= WINDOW:
                    found.append(spans(h))
                    own.append(np.full(len(found[-1][0]), k))
            at = np.concatenate(own) if own else np.empty(0, int)
            anchor, span, start, n = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int) for _ in range(4))
            return {
                "id": pa.array(np.array(columns["id"], np.int64)[at]), "shard": pa.array(np.array(columns["shard"], np.int32)[at]),
                "anchor": pa.array(anchor, pa.int64()), "span": pa.array(span, pa.int64()), "start": pa.array(start, pa.int32()), "n": pa.array(n, pa.int32()),
            }

        return work

    known = docs.where("id IS NOT NULL AND text IS NOT NULL")
    every = common.materialise(common.map_rows(known.select("id", "shard", "text"), "id long, shard int, anchor long, span long, start int, n int", find), "spans")
    shared = common.materialise(every.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor"), "anchors")
    met = common.materialise(common.keep_likely(every, shared, "anchor").join(shared, "anchor"), "shared-spans")
    common.discard(every, shared)

    classes = met.groupBy("anchor", "span").agg(F.min(F.struct("id", "start", "n")).alias("first"), F.max("id").alias("high"))
    classes = common.materialise(classes.select("anchor", "span", "high", "first.*"), "classes")
    several = common.materialise(classes.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "several")  # written, so that joins with it can split hot anchors
    whole = classes.join(several, "anchor", "left_anti").where("id < high").select("anchor", "span", F.col("id").alias("source"), "start", (F.col("start") + F.col("n") + WINDOW - 1).alias("stop"))
    parts, used = _shared_parts(docs, classes.join(several, "anchor", "left_semi"))
    places = common.materialise(whole.unionAll(parts), "places")
    common.discard(classes, several, *used)

    there = met.groupBy("anchor", "span", "shard").agg(F.max("id").alias("id"))
    needed = there.join(places, ["anchor", "span"]).where("source < id").groupBy("shard", "source").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))  # at most one a word of the source
    needed = common.materialise(needed, "passages")
    common.discard(met, places)
    return needed


def _shared_parts(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(anchor, span, source, start, stop) for spans whose anchor is in different spans too, and the tables this reads.

    Only the first document of each class gives its windows, not all that have the span.
    """
    firsts = classes.groupBy("id").agg(F.collect_list(F.struct("anchor", "span", "high", "start", "n")).alias("own"))  # at most one a word of the document
    firsts = common.materialise(firsts, "firsts")

    def windows():
        def work(columns: dict[str, list]) -> dict[str, list]:
            rows: list[tuple] = []
            found = []
            for i, text, own in zip(columns["id"], columns["text"], columns["own"]):
                h = common.word_hashes(text)
                if len(h) < WINDOW:
                    continue
                all_ = common.rolled(h, WINDOW).view(np.int64)
                for s in own:
                    x = all_[s["start"] : s["start"] + s["n"]]
                    rows.append((i, s["anchor"], s["span"], s["high"], s["start"], len(x)))
                    found.append(x)
            n = [r[-1] for r in rows]
            flat = {name: np.repeat(np.array([r[k] for r in rows], np.int64), n) for k, name in enumerate(("id", "anchor", "span", "high", "start"))}
            offset = np.concatenate([np.arange(k) for k in n]) if rows else np.empty(0, np.int64)
            return {k: pa.array(v) for k, v in flat.items() if k != "start"} | {"window": pa.array(np.concatenate(found) if found else [], pa.int64()), "start": pa.array(flat["start"] + offset, pa.int32())}

        return work

    texts = common.keep_likely(docs.select("id", "text"), firsts, "id").join(firsts, "id")
    seen = common.materialise(common.map_rows(texts, "id long, anchor long, span long, high long, window long, start int", windows), "windows")
    first = seen.groupBy("window").agg(F.min(F.struct("id", "start")).alias("first"), F.max("high").alias("last")).where("first.id < last")
    first = common.materialise(first.select("window", F.col("first.id").alias("source"), F.col("first.start").alias("at")), "recurring")
    both = seen.select("window", "anchor", "span", "high").join(first, "window").where("source < high")
    # the shared windows of two spans follow each other; a source that has them twice gives two ranges
    near = both.groupBy("anchor", "span", "source", F.floor(F.col("at") / (2 * WINDOW)).alias("near"))
    return near.agg(F.min("at").alias("start"), (F.max("at") + WINDOW).alias("stop")).drop("near"), [firsts, seen, first]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping word ranges as one."""
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


HALF = WINDOW // 2
#: Letters of the alphabet for each place in a word's code: an automaton's node looks through its edges one by one.
BASE = 64


class Shard:
    """The passages that may be in a shard's documents, and their automaton."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.passages: list[tuple[int, list[int]]] = []
        self.lines: list[str] = []
        self.automaton = None

    def add(self, source: int, words: list[bytes]) -> None:
        """A passage of the document ``source``."""
        if len(words) >= WINDOW:
            self.passages.append((source, [self.number.setdefault(x, len(self.number)) for x in words]))

    def ready(self) -> None:
        """Code the words, cut the passages into blocks and build the automaton.

        A word is as many letters as its shard's words need; each place has letters of its own, so hits begin and end at words.
        """
        import ahocorasick

        if not self.passages:
            return
        self.width = next(w for w in range(2, 12) if BASE**w >= len(self.number))
        coded = ["".join([chr(2 + BASE * w + n // BASE**w % BASE) for w in range(self.width)]) for n in range(len(self.number))]
        self.letters = dict(zip(self.number, coded))
        blocks: dict[str, list[tuple[int, int]]] = {}
        step = HALF * self.width
        for k, (_, numbers) in enumerate(self.passages):
            self.lines.append("".join([coded[n] for n in numbers]))
            for at in range(0, len(self.lines[-1]) - step + 1, step):
                blocks.setdefault(self.lines[-1][at : at + step], []).append((k, at // self.width))
        self.automaton = ahocorasick.Automaton()
        for block, places in blocks.items():
            self.automaton.add_word(block, places)
        self.automaton.make_automaton()

    def marked(self, words: list[bytes], own: int) -> list[tuple[int, int]]:
        """Word ranges that also are in a passage of a document with a smaller id than ``own``."""
        if self.automaton is None or len(words) < WINDOW:
            return []
        width, get, other = self.width, self.letters.get, OTHER * self.width
        line = "".join([get(x, other) for x in words])
        out, reached = [], {}
        for end, places in self.automaton.iter(line):
            stop = (end + 1) // width
            for k, at in places:
                if self.passages[k][0] >= own:
                    continue
                shift = stop - HALF - at  # the place in the document that the passage's first word falls on
                if reached.get((k, shift), 0) >= stop:
                    continue
                low, high = equal_around(self.lines[k], line, at, at + HALF, shift, width)
                reached[k, shift] = high + shift
                if high - low >= WINDOW:
                    out.append((low + shift, high + shift))
        return merged(out)


def equal_around(passage: str, line: str, low: int, high: int, shift: int, width: int) -> tuple[int, int]:
    """The widest range of words around ``low`` to ``high`` in which a passage equals a line that is ``shift`` words ahead."""
    first, last, by = max(0, -shift) * width, min(len(passage), len(line) - shift * width), HALF * width
    low, high, shift = low * width, high * width, shift * width
    while high + by <= last and passage[high : high + by] == line[high + shift : high + shift + by]:
        high += by
    while high < last and passage[high : high + width] == line[high + shift : high + shift + width]:
        high += width
    while low > first and passage[low - width : low] == line[low - width + shift : low + shift]:
        low -= width
    return low // width, high // width


def _cut():
    def work(columns: dict[str, list]) -> dict[str, list]:
        out = []
        for text, ranges in zip(columns["text"], columns["ranges"]):
            w = split(text)
            pieces = [w[a:b] for a, b in merged([(r["start"], r["stop"]) for r in ranges])]
            out.append([b" ".join(p) for p in pieces if len(p) >= WINDOW])
        return {"shard": columns["shard"], "source": columns["source"], "passages": out}

    return work


RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's passages come first, then its documents."""
    current, shard, built = None, Shard(), False
    for whole in batches:
        for at in range(0, whole.num_rows, common.BATCH_ROWS):
            batch = whole.slice(at, common.BATCH_ROWS)
            out: list[tuple] = []
            for number, source, passages, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                if number != current:
                    current, shard, built = number, Shard(), False
                if source is not None:
                    for p in passages:
                        shard.add(source, split(p))
                    continue
                if not built:
                    shard.ready()
                    built = True
                w = split(text)
                gone = shard.marked(w, i) if i is not None else []
                kept = without(w, gone) if gone else w
                joined = b" ".join(kept)
                out.append((i, len(w), len(w) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if gone else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(RESULT)], schema=RESULT)


def without(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    """``words`` without the ranges, which are in order and apart."""
    out, at = [], 0
    for start, stop in ranges:
        out += words[at:start]
        at = stop
    return out + words[at:]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: id, n_words, n_removed, kept_sha256, and kept_text where words were removed (else null)."""
    docs, shards = sharded(df, id_col, text_col)
    needed = wanted_passages(docs)
    sources = common.keep_likely(docs.select(F.col("id").alias("source"), "text"), needed.select("source").distinct(), "source").join(needed, "source")
    passages = common.map_rows(sources.select("shard", "source", "text", "ranges"), "shard int, source long, passages array<binary>", _cut)
    nothing = F.lit(None)
    rows = passages.select("shard", "source", "passages", nothing.cast("long").alias("id"), nothing.cast("binary").alias("text"))
    rows = rows.unionByName(docs.select("shard", nothing.cast("long").alias("source"), nothing.cast("array<binary>").alias("passages"), "id", "text"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("source").asc_nulls_last())
    return rows.mapInArrow(_streamed, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("id", id_col)
