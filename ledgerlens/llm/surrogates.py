"""Personal data by surrogate generation.

Detected entities get keyed, type-consistent replacements. A replacement is a keyed permutation (a Feistel network over
the values of an entity's letters and digits, walked until it lands in range) of all strings of the same format: digits
stay digits, letters keep case and script, separators, country codes and key prefixes stay, card numbers keep their
check digit valid or invalid, addresses keep their top-level domain. Titles stay with names; a known first name becomes
another one of the same gender and script, other parts of a name keep script, the kind of their vowels and their last
letter. Equal entities get equal surrogates in every document, and a permutation gives distinct ones distinct surrogates;
what is left to check, over the whole corpus, is that no surrogate is an entity's original or meets another entity's
surrogate: those entities take the next attempt. An entity with nothing to permute, and one whose first ``FRESH``
attempts all collide, gets a string drawn from the key in its script, which has no part of the original.

Detected: e-mail addresses, secrets after a keyword, access keys, long hexadecimal strings, public IPv4 and IPv6
addresses, account numbers, telephone numbers with a country code or in the usual North American forms, social security
and card numbers, names after a title, and names that begin with one of the known first names. Names without either,
national telephone numbers of other forms and postal addresses are not.

Defined cases: null text stays null with no entities; texts without entities stay as they are; rows that repeat are
treated alike; null and repeated ids are kept; entities without letters or digits, and letters of any script, are
replaced as others; very long texts are searched whole; an empty table gives no rows; of other columns none is needed or
changed.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common

ROUNDS = 8
#: Attempts in the entity's own format, and attempts in all: then the format and all drawn strings are taken, an error.
FRESH, MOST_ATTEMPTS = 6, 40
#: Titles, and first names by script and gender.
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Doctor|Herr|Frau|Doktor|Mme|Mlle|Monsieur|Madame|Docteur|Professeur|Señor|Señora|Sra?|Don|Doña|Doctora?|Profesora?|Господин|Госпожа"
FIRST_NAMES = [
    "Anna Maria Emma Laura Julia Sophie Clara Elena Sarah Lisa Marie Camille Carmen Lucia Ingrid Helga Claire Louise Isabel Teresa Mary Jane Emily Alice Linda Susan Patricia Barbara Katharina Petra".split(),
    "John James Thomas Peter Paul Michael Daniel David Hans Karl Stefan Lukas Pierre Antoine Carlos Juan Miguel Pablo Robert William George Henry Richard Charles Joseph Klaus Jürgen Wolfgang François José".split(),
    "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    "Иван Пётр Сергей Андрей Дмитрий Алексей Николай Михаил Владимир Павел".split(),
    "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Δήμητρα Βασιλική".split(),
    "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Βασίλης Χρήστος".split(),
]
NAMES_OF = {n: names for names in FIRST_NAMES for n in names}
ENTITY = re.compile(
    r"""(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)
    |(?P<keyed>\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[:=]\s*["']?)(?P<secret>[^\s"'<>,;]{8,})
    |(?P<aws>\b[AK][SK]IA[0-9A-Z]{16}\b)
    |(?P<hex>\b(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}\b)
    |(?P<ip>\b(?:\d{1,3}\.){3}\d{1,3}\b)
    |(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f]{1,4}:)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:]))
    |(?P<iban>\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<phone>\+\d{1,3}(?:[ ./-]?\(\d{1,4}\))?(?:[ ./-]?\d){5,13}(?!\d)|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b)
    |(?P<ssn>\b\d{3}-\d{2}-\d{4}\b)
    |(?P<card>\b\d(?:[ -]?\d){12,18}\b)""",
    re.X,
)
HINT = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|key)")
PART = r"[^\W\d_a-zа-яß-ÿ][\w'’-]+"
NAME = re.compile(rf"\b(?:(?:{TITLES})\.?[ ])+(?P<name>{PART}(?:[ ]{PART}){{0,2}})")
KNOWN_NAME = re.compile(rf"\b(?P<name>(?:{'|'.join(NAMES_OF)})(?:[ ]{PART}){{1,2}})")
FIRST_HINT = re.compile("|".join(f"{n} " for n in NAMES_OF))
#: Letter classes by script; a letter is replaced within its class.
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåèéêëìíîïòóôõöùúûü", "ñçß", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "ÑÇ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΆΈΉΊΌΎΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"]
HEX = "0123456789abcdef"
CLASS_OF = {c: k for k in CLASSES for c in k}


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(f"{tweak}|{r}|{right}".encode("utf-8", "surrogatepass"), key=key, digest_size=min(64, max(8, width))).digest()
            f = int.from_bytes((f * (width // len(f) + 1))[: max(8, width)], "big") & mask
            left, right = right, left ^ f
        value = left << half | right
        if value < size:
            return value


@functools.lru_cache(4096)
def class_of(c: str) -> str:
    """What may stand for a character: its letter class, or the letters or digits of its kind around it in its script."""
    if c in CLASS_OF:
        return CLASS_OF[c]
    if c.isdecimal():
        return "".join(chr(ord(c) - unicodedata.decimal(c) + d) for d in range(10))
    if not c.isalpha():
        return ""
    kind = lambda x: (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0])
    low = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(low, low + 256)) if x not in CLASS_OF and kind(x) == kind(c))


def reshaped(text: str, key: bytes, tweak: str, fixed: int = 0, classes: dict[str, str] | None = None) -> str:
    """``text`` with its letters and digits after the first ``fixed`` characters permuted within their classes."""
    of = class_of if classes is None else lambda c: classes.get(c, "")
    at = [(i, k) for i, c in enumerate(text) if i >= fixed and len(k := of(c)) > 1]
    value, size = 0, 1
    for i, k in at:
        value, size = value * len(k) + k.index(text[i]), size * len(k)
    free = {i for i, _ in at}
    shape = "".join("x" if i in free else c for i, c in enumerate(text))
    if size < 2:
        return fresh(text, key, tweak)
    tweak = f"{tweak}|{shape}|{'|'.join(k[0] for _, k in at)}"
    made = permuted(value, size, key, tweak)
    if made == value:  # the few strings that a permutation leaves in place go to where its last one goes
        made = permuted(size - 1, size, key, tweak)
        made = (made + 1) % size if made == value else made
    out = list(text)
    for i, k in reversed(at):
        made, d = divmod(made, len(k))
        out[i] = k[d]
    return "".join(out)


def fresh(text: str, key: bytes, tweak: str, least: int = 8) -> str:
    """A string drawn from the key, of the script and at least the length of ``text``, without any part of it."""
    letters = next((k for c in text if c.isalpha() and len(k := class_of(c.lower())) > 3), "")
    if not letters or letters[0].isascii():
        letters = "abcdefghijklmnopqrstuvwxyz"
    size = max(least, len(text))
    drawn = b"".join(hashlib.blake2b(f"{tweak}|{text}|{k}".encode("utf-8", "surrogatepass"), key=key, digest_size=64).digest() for k in range(-(-size // 32)))
    out = "".join(letters[int.from_bytes(drawn[2 * i : 2 * i + 2], "big") % len(letters)] for i in range(size))
    return out.capitalize() if text[:1].isupper() else out


def other_first_name(name: str, key: bytes, attempt: int) -> str:
    """Another name of the same list: lists are turned in a keyed order, so different names stay different."""
    turned = sorted(NAMES_OF[name], key=lambda n: hashlib.blake2b(n.encode(), key=key, digest_size=8).digest())
    return turned[(turned.index(name) + 1 + attempt % (len(turned) - 1)) % len(turned)]


def luhn(digits: str) -> int:
    return sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def surrogate(kind: str, text: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity; the same for the same key and attempt."""
    tweak = f"{kind}|{attempt}"
    if attempt >= FRESH and kind in ("name", "secret", "hex"):
        return fresh(text, key, tweak, 8 + attempt // 4)
    if kind == "email":
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        if attempt >= FRESH:
            return f"{fresh(local, key, f'{tweak}|{domain.lower()}')}@{reshaped('.'.join(labels[:-1]), key, 'domain')}.{labels[-1]}"
        return f"{reshaped(local, key, f'{tweak}|{domain.lower()}')}@{reshaped('.'.join(labels[:-1]), key, 'domain')}.{labels[-1]}"
    if kind == "ip":
        a, *rest = (int(x) for x in text.split("."))
        value = ((a - 1) * 256 + rest[0]) << 16 | rest[1] << 8 | rest[2]
        while True:  # walked on to an address that can belong to somebody, like the original
            value = permuted(value, 223 << 24, key, tweak)
            made = f"{(value >> 24) + 1}.{value >> 16 & 255}.{value >> 8 & 255}.{value & 255}"
            if public_address(made):
                return made
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        inner = reshaped(digits[1:-1], key, f"{tweak}|{digits[0]}|{luhn(digits)}")
        new = next(n for n in (digits[0] + inner + str(d) for d in range(10)) if luhn(n) == luhn(digits))
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in text)
    if kind == "ipv6":
        head, _, rest = text.partition(":")
        own = HEX.upper() if text.isupper() else HEX
        return f"{head}:{reshaped(rest if text.isupper() else rest.lower(), key, f'{tweak}|{head}', 0, dict.fromkeys(own, own))}"
    if kind == "phone":
        head = re.match(r"\+(?:\d{1,3}(?=[ ./(-])|[17]|\d\d)", text)
        return reshaped(text, key, tweak, head.end() if head else 0)
    if kind == "iban":
        plain = text.replace(" ", "")
        body = reshaped(plain[4:], key, f"{tweak}|{plain[:2]}")
        number = "".join(str(int(c, 36)) for c in body + plain[:2] + "00")
        it = iter(plain[:2] + f"{98 - int(number) % 97:02d}" + body)
        return "".join(c if c == " " else next(it) for c in text)
    if kind == "aws":
        return reshaped(text, key, tweak, 4)
    if kind in ("hex", "secret"):
        lower = set(text) <= set(HEX)
        return reshaped(text, key, tweak, 0, dict.fromkeys(HEX, HEX) if lower else None)
    if kind == "name":  # each part for itself: the same surname in a longer and a shorter form stays the same
        return " ".join(other_first_name(p, key, attempt) if p in NAMES_OF else name_part(p, key, attempt) for p in text.split(" "))
    return reshaped(text, key, tweak)


def name_part(part: str, key: bytes, attempt: int) -> str:
    """A part of a name; in scripts with case its last letter stays, if that leaves enough to permute."""
    if len(part) > 2 and part[-1].islower():
        return reshaped(part[:-1], key, f"name|{attempt}|{part[-1]}") + part[-1]
    return reshaped(part, key, f"name|{attempt}")


def public_address(text: str) -> bool:
    """Whether the number is an address that can belong to somebody; private ones are shared by all."""
    a, b, *_ = parts = [int(x) for x in text.split(".")]
    return max(parts) < 256 and 0 < a < 224 and a not in (10, 127) and (a, b) != (192, 168) and not (a == 172 and 16 <= b < 32)


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, entity) in text order, without overlaps."""
    out = []
    if text and HINT.search(text):
        for m in ENTITY.finditer(text):
            kind = m.lastgroup
            if kind == "ip" and not public_address(m[kind]) or kind == "ipv6" and not public_address_6(m[kind]):
                continue
            out.append((*m.span(kind), kind, m[kind]))
    if text:
        named = list(NAME.finditer(text))
        if FIRST_HINT.search(text):
            named += KNOWN_NAME.finditer(text)
        found = len(out)
        for m in sorted(named, key=lambda m: m.start("name")):
            a, b = m.span("name")
            if (len(out) == found or out[-1][1] <= a) and all(y <= a or x >= b for x, y, _, _ in out[:found]):
                out.append((a, b, "name", m["name"]))
        out.sort()
    return out


def public_address_6(text: str) -> bool:
    """Whether the text is an IPv6 address of a host, and not of the own machine, link or group."""
    try:
        made = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return not (made.is_loopback or made.is_link_local or made.is_multicast or made.is_unspecified)


def replace_entities(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with surrogates, n_replaced, kinds)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", "text"))

    def find():
        def work(columns):
            found = [(i, k, e) for i, t in zip(columns["row"], columns["text"]) for k, e in sorted({x[2:] for x in entities(t)})]
            return {n: [x[c] for x in found] for c, n in enumerate(("row", "kind", "entity"))}

        return work

    def suggest():
        return lambda c: c | {"made": [surrogate(k, e, key, a) for k, e, a in zip(c["kind"], c["entity"], c["attempt"])]}

    id_type = docs.schema["id"].dataType.simpleString()
    seen = common.materialise(common.map_rows(docs.select("row", "text"), "row long, kind string, entity string", find), "entities")
    known = common.materialise(seen.select("kind", "entity").distinct(), "known")
    real = known.select(F.col("entity").alias("made"), F.lit(True).alias("real")).distinct()
    tried = known.withColumn("attempt", F.lit(0))
    for _ in range(MOST_ATTEMPTS):
        tried = common.materialise(common.map_rows(tried.select("kind", "entity", "attempt"), "kind string, entity string, attempt int, made string", suggest), "surrogates")
        first = tried.groupBy("made").agg(F.min(F.struct("attempt", "kind", "entity")).alias("first"))
        bad = (F.struct("attempt", "kind", "entity") != F.col("first")) | F.col("real").isNotNull()
        judged = tried.join(first, "made").join(real, "made", "left").select("kind", "entity", (F.col("attempt") + bad.cast("int")).alias("attempt"), bad.alias("bad"))
        if not judged.where("bad").head(1):
            break
        tried = judged
    else:
        raise ValueError(f"no distinct surrogates in {MOST_ATTEMPTS} attempts")
    changed = tried.where("attempt > 0").join(seen, ["kind", "entity"]).groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "entity"), "attempt"))).alias("attempts"))

    def write():
        def one(text, attempts):
            found, out, at = entities(text), [], 0
            attempts = dict(attempts or ())
            for start, stop, kind, entity in found:
                out += [text[at:start], surrogate(kind, entity, key, attempts.get(f"{kind}|{entity}", 0))]
                at = stop
            return (None if text is None else "".join(out) + text[at:]), len(found), ",".join(sorted({f[2] for f in found}))

        def work(columns):
            made = [one(t, a) for t, a in zip(columns["text"], columns["attempts"])]
            return {"id": columns["id"], "text": [m[0] for m in made], "n_replaced": [m[1] for m in made], "kinds": [m[2] for m in made]}

        return work

    out = common.map_rows(docs.join(changed, "row", "left").select("id", "text", "attempts"), f"id {id_type}, text string, n_replaced int, kinds string", write)
    return out.withColumnRenamed("id", id_col)
