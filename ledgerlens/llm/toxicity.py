"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by their common subsequences of three letters, gaps allowed, each weighted by ``DECAY`` to
the power of the letters it spans (up to ``SPAN``) and normalised: an insult with a letter put in, left out or inflected
stays close to the insult. Landmarks are witness words; the Nyström map takes a word's kernel values with them to a
vector, on which a linear machine with squared hinge loss is trained. Its decision is a sum over landmarks, so it folds
into one weight a subsequence, which scores a word without the landmarks at hand.

Labels are of whole texts, so training is multiple-instance: a toxic text is a bag of sentences with at least one word
that marks it. First witnesses are words with letter runs that are far more frequent in toxic texts; each round then
takes the highest word of every toxic text as positive, and the highest of every clean one as negative. The score of a
text is a logistic function of its highest word; past the point where witnessed texts begin it rises more slowly.

Training reads at most about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows of about ``TOXIC_BYTES`` and ``CLEAN_BYTES``,
whole texts chosen by a hash of id and text: the documented bound of the fit. Only their different words reach the
driver. Words are split at white space; runs of single letters are joined; digits and signs that stand for
letters are read as these; words over ``LONGEST`` letters are cut into overlapping pieces.

Defined cases: null and empty texts get the score of a text without words; without labelled rows of both kinds every
score is the share of toxic rows (0 if there are none); null labels and ids are not learned from; repeated rows are
scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common

TOXIC_ROWS, CLEAN_ROWS = 1800, 6500
TOXIC_BYTES, CLEAN_BYTES = 12 << 20, 40 << 20
DECAY, SPAN, LETTERS, LONGEST = 0.7, 6, 64, 32
LANDMARKS, ROUNDS = 384, 4
#: Toxic texts that must share a letter run before it can mark a witness.
EVIDENCE = 8
#: Directions of the landmarks' kernel matrix below this share of the largest are noise.
CUTOFF = 1e-4
#: Share of the witnessed toxic training texts whose decision values may be under the point from which scores rise more
#: slowly, and how much more slowly.
UNDER, SLOWLY = 0.02, 0.1
#: How many times more frequent than chance a witness's letter run is in toxic texts.
CONTRAST = 40
#: Highest words of clean texts that a round adds to the negatives.
HARD = 3000
CACHE = 1_000_000
EDGE = re.compile(r"^\W+|\W+$")
SPELLED = re.compile(r"(?<!\S)(?:\w\W?\s+){2,}\w(?!\S)")
SIGNS = re.compile(r"[\W_]+")
#: Signs that stand for letters.
LEET = str.maketrans("013457@$", "oieastas")
SIGN_LETTERS = str.maketrans("@$", "as")
SIGN_LETTER = re.compile(r"[@$]")
RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text, runs of single letters joined besides."""
    low = (text or "").lower()
    found = low.split()
    if len(found) > 2:
        found += ["".join(m[0].split()) for m in SPELLED.finditer(low)]
    return found


def cleaned(word: str) -> list[str]:
    """The pieces of a word that are scored.

    Words with digits or signs are read in two ways: signs dropped and digits read as letters, each run of letters for
    itself; and the letters alone, whatever parts them. Digits are not read as letters where there is no letter.
    """
    bare = EDGE.sub("", word)
    if bare.isalpha() and not SIGN_LETTER.search(word):
        read = [bare]
    else:
        letters = "".join(filter(str.isalpha, word))
        as_letters = SIGNS.sub("", EDGE.sub("", word.translate(LEET if letters else SIGN_LETTERS)))
        read = list(dict.fromkeys([*RUN.findall(as_letters), letters]))
    out = []
    for r in read:
        if 3 <= len(r) <= LONGEST:
            out.append(r)
        elif len(r) > LONGEST:
            out += [r[at : at + LONGEST] for at in range(0, len(r) - LONGEST // 2, LONGEST // 2)]
    return out


class Letters:
    """Letters to numbers: the most frequent ones of the training words, all others together."""

    def __init__(self, words: list[str]) -> None:
        self.code = {c: i for i, c in enumerate(["^", "$", *(c for c, _ in Counter("".join(words)).most_common(LETTERS - 3))])}

    def matrix(self, words: list[str]) -> np.ndarray:
        """Codes of words of one length, with their two ends as letters."""
        get = self.code.get
        return np.array([[0, *[get(c, LETTERS - 1) for c in w], 1] for w in words], np.int32)


def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n letters within ``SPAN``, and their weights."""
    found = [t for t in combinations(range(n), 3) if t[2] - t[0] < SPAN]
    at = np.array(found, np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


PLACES = {n: places(n) for n in range(5, LONGEST + 3)}


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence numbers, normalised weights) of words of one length; equal subsequences are summed in the norm."""
    at, weight = PLACES[codes.shape[1]]
    keys = (codes[:, at[:, 0]] * LETTERS + codes[:, at[:, 1]]) * LETTERS + codes[:, at[:, 2]]
    order = np.argsort(keys, 1)
    sorted_, w = np.take_along_axis(keys, order, 1), weight[order]
    new = np.ones(keys.shape, bool)
    new[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    row = np.repeat(np.arange(len(codes)), new.sum(1))
    norm = np.sqrt(np.bincount(row, sums.astype(np.float64) ** 2, len(codes)))
    return keys, weight[None, :] / norm[:, None].astype(np.float32)


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


class Machine:
    """Scores words and texts; what training leaves."""

    def __init__(self, letters: Letters, table: np.ndarray, bias: float, line: np.ndarray, past: float) -> None:
        self.letters, self.table, self.bias, self.line, self.past = letters, table, bias, line, past

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Decision values of cleaned pieces."""
        out = np.full(len(pieces), -2.0)
        for n, rows in by_length(pieces).items():
            for low in range(0, len(rows), 2048):
                part = rows[low : low + 2048]
                keys, weights = subsequences(self.letters.matrix([pieces[i] for i in part]))
                out[part] = (self.table[keys] * weights).sum(1) + self.bias
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Decision values of raw words: the highest of a word's pieces."""
        flat, owner = [], []
        for i, w in enumerate(words):
            for piece in cleaned(w):
                flat.append(piece)
                owner.append(i)
        out = np.full(len(words), -2.0)
        if flat:
            np.maximum.at(out, owner, self.pieces(flat))
        return out

    def score(self, high: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(bent(high, self.past) @ self.line, -30, 30)))


def bent(high: np.ndarray, past: float) -> np.ndarray:
    """Decision values as the logistic function takes them: what is past ``past`` counts less, in the same order."""
    return np.stack([np.ones_like(high), np.minimum(high, past) + SLOWLY * np.maximum(high - past, 0)], 1)


class Constant:
    """Where there is nothing to learn from."""

    def __init__(self, share: float) -> None:
        self.share = share

    def words(self, words: list[str]) -> np.ndarray:
        return np.full(len(words), -2.0)

    def score(self, high: np.ndarray) -> np.ndarray:
        return np.full(len(high), self.share)


def kernel(letters: Letters, words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values (word, landmark)."""
    used: list[np.ndarray] = []
    for rows in by_length(landmarks).values():
        used.append(np.unique(subsequences(letters.matrix([landmarks[i] for i in rows]))[0]))
    used_keys = np.unique(np.concatenate(used))
    column = np.full(LETTERS**3, len(used_keys), np.int64)
    column[used_keys] = np.arange(len(used_keys))

    marks = np.zeros((len(used_keys) + 1, len(landmarks)), np.float32)
    for rows in by_length(landmarks).values():
        keys, weights = subsequences(letters.matrix([landmarks[i] for i in rows]))
        np.add.at(marks, (column[keys], np.array(rows)[:, None]), weights)
    marks[-1] = 0
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for rows in by_length(words).values():
        for low in range(0, len(rows), 64):
            part = rows[low : low + 64]
            keys, weights = subsequences(letters.matrix([words[i] for i in part]))
            out[part] = (weights[:, None, :] @ marks[column[keys]])[:, 0]
    return out


def linear_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 30.0) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by Newton steps; the bias is not penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (z @ w) < 1
        own = z[active] * weight[active, None]
        new = np.linalg.solve(ridge + 2 * cost * own.T @ z[active], 2 * cost * own.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def fit_line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.1 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def first_witnesses(names: list[str], bags: list[np.ndarray], toxic: np.ndarray) -> dict[int, float]:
    """Words with a run of four letters that is far more frequent in toxic bags, with that run's weight of evidence."""
    runs = lambda w: [w[k : k + 4] for k in range(max(1, len(w) - 3))]
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for bag, y in zip(bags, toxic):
        count[int(y)].update({g for i in bag.tolist() for g in runs(names[i])})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    strong = {}
    for g, n in count[1].items():
        usual = (count[0][g] + 0.5) * n1 / n0
        if n >= EVIDENCE and n >= CONTRAST * usual:
            strong[g] = (n - usual) / np.sqrt(usual + 1)
    seen = np.unique(np.concatenate([b for b, y in zip(bags, toxic) if y]))
    found = ((i, max(strong.get(g, 0.0) for g in runs(names[i]))) for i in seen.tolist())
    return {i: e for i, e in found if e > 0}


def disguised(word: str) -> list[str]:
    """Forms of a word with a letter put in, doubled or left out, at places that the word itself decides."""
    n = len(word)
    at = 1 + sum(map(ord, word)) % max(1, n - 1)
    out = [word[:at] + "xvzjq"[(at + n) % 5] + word[at:], word[:at] + word[at - 1] + word[at:]]
    return out + [word[:at] + word[at + 1 :]] * (n > 5 and at < n - 1)


def pieces_of(text: str | None) -> list[str]:
    """The different pieces of a text."""
    return list(dict.fromkeys(p for w in dict.fromkeys(words_of(text)) for p in cleaned(w)))


def fit(texts: Iterable[str | None], labels: list[int]) -> Machine | Constant:
    """Train on labelled texts."""
    return fit_pieces((pieces_of(t) for t in texts), labels)


def fit_pieces(pieces: Iterable[list[str]], labels: list[int]) -> Machine | Constant:
    """Train on the different pieces of labelled texts."""
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return Constant(float(toxic.mean()) if len(toxic) else 0.0)
    index: dict[str, int] = {}
    bags = [np.array(sorted({index.setdefault(p, len(index)) for p in own}), np.int32) for own in pieces]
    names = list(index)
    del index
    in_toxic, in_clean = (np.bincount(np.concatenate([np.empty(0, np.int32), *(b for b, y in zip(bags, toxic) if y == side)]), minlength=len(names)) for side in (True, False))
    witness = first_witnesses(names, bags, toxic) if names else {}
    letters = Letters(names)
    ratio = toxic.sum() / max(1, (~toxic).sum())
    rare = in_clean * ratio * 5 < in_toxic
    positive = sorted((i for i in witness if rare[i]), key=lambda i: (-in_toxic[i] * witness[i], names[i]))[:600]
    if not positive or not in_clean.any():
        return Constant(float(toxic.mean()))
    usual = sorted(np.flatnonzero(in_clean).tolist(), key=lambda i: (-in_clean[i], names[i]))
    negative = set(usual[:1500]) | set(sorted(usual[1500:])[:: max(1, len(usual) // 2500)])
    f = None
    for _ in range(ROUNDS):
        own = list(dict.fromkeys([names[i] for i in positive] + [v for i in positive[:150] for v in disguised(names[i])]))
        rest = sorted(negative - set(positive), key=lambda i: names[i])
        hard = sorted(rest, key=lambda i: ((-in_clean[i] if f is None else -f[i]), names[i]))
        chosen = hard[: LANDMARKS // 3] + rest[:: max(1, len(rest) * 6 // LANDMARKS)][: LANDMARKS // 6]
        marks = list(dict.fromkeys(own[: LANDMARKS // 2] + [names[i] for i in chosen]))
        values, vectors = np.linalg.eigh(kernel(letters, marks, marks).astype(np.float64))
        good = values > CUTOFF * values.max()
        root = vectors[:, good] / np.sqrt(values[good])  # the Nyström map of kernel values with the landmarks
        x = kernel(letters, own + [names[i] for i in rest], marks) @ root
        y = np.array([1.0] * len(own) + [-1.0] * len(rest))
        known = {names[i]: in_toxic[i] for i in positive}
        weight = np.sqrt(1 + np.array([known.get(w, EVIDENCE) for w in own] + in_clean[rest].tolist()))  # a word counts by the texts it decides
        for side in (1.0, -1.0):
            weight[y == side] *= len(y) / 2 / max(1e-9, weight[y == side].sum())
        w, bias = linear_machine(x, y, weight)
        del x
        alpha = root @ w
        table = np.zeros(LETTERS**3, np.float32)
        for rows in by_length(marks).values():
            keys, weights = subsequences(letters.matrix([marks[i] for i in rows]))
            np.add.at(table, keys, weights * alpha[rows][:, None].astype(np.float32))
        f = Machine(letters, table, bias, np.zeros(2), 1.0).pieces(names)
        tops = [int(b[f[b].argmax()]) if len(b) else None for b in bags]
        fresh = {t for t, toxic_ in zip(tops, toxic) if toxic_ and t in witness and rare[t]}
        positive = list(dict.fromkeys([i for i in positive if f[i] > -0.5] + sorted(fresh, key=lambda i: (-in_toxic[i], names[i]))))[:900]
        wrong = sorted((i for i in np.flatnonzero((in_clean > 0) & (f > -0.7)).tolist() if i not in fresh), key=lambda i: (-f[i], names[i]))
        negative |= set(wrong[:HARD]) | {t for t, toxic_ in zip(tops, toxic) if not toxic_ and t is not None and f[t] > -0.7}
    high = np.array([f[b].max() if len(b) else -2.0 for b in bags])
    marked = np.array([np.isin(b, np.array(list(witness))).any() for b in bags])
    past = max(0.5, float(np.quantile(high[toxic & marked], UNDER)))
    line = fit_line(bent(np.minimum(high, past), past), toxic.astype(float))
    return Machine(letters, table, bias, line, past)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine | Constant:
    """Fit on a bounded sample of the labelled rows."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    own = F.pmod(F.xxhash64("id", "text", F.lit("toxicity")), F.lit(1 << 50))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    sized = common.materialise(rows.select("id", own.alias("own"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(known, "id"), "labels")
    totals = {r["y"]: (r["n"], r["size"] or 0) for r in sized.groupBy("y").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}

    def share(y: int, most: int, most_bytes: int) -> float:
        n, size = totals.get(y, (0, 0))
        return min(1.0, most / max(1, n), most_bytes / max(1, size))

    part = F.when(F.col("y") == 1, share(1, TOXIC_ROWS, TOXIC_BYTES)).otherwise(share(0, CLEAN_ROWS, CLEAN_BYTES))
    chosen = common.materialise(sized.where(F.col("own") / float(1 << 50) < part).select("id", "own", "y").distinct(), "chosen")

    def cut():
        return lambda c: c | {"pieces": [" ".join(pieces_of(t)) for t in c["text"]]}

    likely = common.keep_likely(rows.withColumn("own", own), chosen, "id").join(chosen, ["id", "own"])
    cut_up = common.map_rows(likely.select("id", "own", "y", "text"), "id long, own long, y int, pieces string", cut).dropDuplicates(["id", "own", "pieces"])
    found = common.materialise(cut_up, "labelled").orderBy("id", "own", "pieces").select("y", "pieces").toArrow()
    return fit_pieces((p.as_py().split() for p in found.column("pieces")), found.column("y").to_pylist())


def score(df: DataFrame, machine: Machine | Constant, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with score and predicted; existing columns of these names are replaced."""
    sent = df.sparkSession.sparkContext.broadcast(machine)  # a table of LETTERS ** 3 weights
    kept = [f for f in df.schema if f.name.lower() not in ("score", "predicted")]

    def each():
        known: dict[str, float] = {}

        def work(columns):
            bags = [words_of(t) for t in columns[text_col]]
            if len(known) > CACHE:
                known.clear()
            fresh = list({w for b in bags for w in b} - known.keys())
            known.update(zip(fresh, sent.value.words(fresh).tolist()))
            values = [np.fromiter(map(known.__getitem__, b), np.float64, len(b)) for b in bags]
            high = np.array([v.max() if len(v) else -2.0 for v in values])
            s = sent.value.score(high)
            return columns | {"score": s.tolist(), "predicted": (s >= threshold).astype(int).tolist()}

        return work

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return common.map_rows(df.select(*[f.name for f in kept]), f"{schema}score double, predicted int", each)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
