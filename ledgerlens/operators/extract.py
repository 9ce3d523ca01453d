"""Relations and facts that texts state: links, terms, declared facts.

Patterns that Spark's regular expressions can say run in the JVM. Facts and inferred predicates depend on the state of a
whole page, so pages go through Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Predicates inferred from words near a link, first match first, and their confidence.
PREDICATES = [("founded", r"\b(?:co-?)?founded\b|\bfounder of\b"), ("invested_in", r"\binvested in\b|\bbacked\b|\binvestor in\b"), ("advises", r"\badvis(?:es|or to|er to)\b"), ("works_at", r"\bworks (?:at|for)\b|\bemployed (?:at|by)\b|\bjoined\b")]
BY_TYPE = {"image": ("image_of", 1.0), "meeting": ("attended", 1.0), "media": ("mentions", 0.6)}
SURE, VAGUE, CONTEXT = 0.95, 0.6, 240
FENCE = re.compile(r"\s*(?:```|~~~)")
HEADING = re.compile(r"\s*(#{2,6})\s+(.+?)\s*#*\s*$")
BULLET = re.compile(r"\s*(?:[-+*]|\d+[.)])\s+(\S.*?)\s*$")
WIKI = re.compile(r"\[\[([^|\]#\n]+)(?:#[^|\]]*)?(?:\|[^\]]+)?\]\]")


def noted(documents: DataFrame) -> DataFrame:
    """Documents as pages (id, key, title, type, body): the whole text, and a section of facts and links about them."""
    note = F.concat(F.lit("\n## Facts\n- Source: "), F.coalesce("source", F.lit("none")), F.lit("\n1. Language: "), F.coalesce("lang", F.lit("none")), F.lit("\n   as labelled\n## Links\nworks at companies/"), F.coalesce("source", F.lit("none")), F.lit(" and see [[Doc "), (F.col("doc_id") + 1).cast("string"), F.lit("]]\n"))
    return documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("docs/doc-"), F.col("doc_id").cast("string")).alias("key"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.lit("person").alias("type"), F.concat(F.coalesce("text", F.lit("")), note).alias("body"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, target, n): link targets in the html of pages."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"#]+)"'), F.lit(1))).alias("target"))
    return found.groupBy("page_id", "target").agg(F.count("*").alias("n"))


def terms(rows: DataFrame, pattern: str, by: str, key: str, text: str = "text") -> DataFrame:
    """(by, term, n, keys): how often, and in how many keys, texts match a pattern."""
    found = rows.select(key, by, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("term"))
    return found.groupBy(by, "term").agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))


def blanked(text: str) -> str:
    """Fenced and inline code as blanks, places kept."""
    text = re.sub(r"```.*?(?:```|\Z)", lambda m: " " * len(m[0]), text, flags=re.S)
    return re.sub(r"`[^`\n]*`", lambda m: " " * len(m[0]), text)


def slug(title: str) -> str:
    return re.sub(r"[\s_-]+", "-", title.strip().removesuffix(".md").casefold()).strip("-")


def predicate_of(kind: str, near: str) -> tuple[str, float]:
    """What a link says, by the page's type, else by the words around it."""
    if kind.lower() in BY_TYPE:
        return BY_TYPE[kind.lower()]
    return next(((p, SURE) for p, words in PREDICATES if re.search(words, near, re.I)), ("mentions", VAGUE))


def references(body: str, directories: Sequence[str]) -> list[tuple[str, str, int]]:
    """(source, target, place) of links in a text without code: markdown, wiki and bare slugs, in page order."""
    own = "(?:" + "|".join(map(re.escape, directories)) + ")"
    out, rest = [], body
    for m in re.finditer(rf"\[[^\]\n]+\]\((?:\.\./)*({own}/[^)\s#]+)(?:#[^)]*)?\)", body, re.I):
        out.append(("markdown", m[1].removesuffix(".md"), m.start(1)))
        rest = rest[: m.start()] + " " * len(m[0]) + rest[m.end() :]
    for m in WIKI.finditer(body):
        target = m[1].strip()
        direct = re.fullmatch(rf"{own}/.*[^/].*", target, re.I)
        out.append(("markdown", target.removesuffix(".md"), m.start(1)) if direct else ("wiki", target, m.start(1)))
        rest = rest[: m.start()] + " " * len(m[0]) + rest[m.end() :]
    out += [("bare-slug", m[1], m.start(1)) for m in re.finditer(rf"\b({own}/[a-z0-9](?:[a-z0-9/_-]*[a-z0-9])?)\b", rest, re.I)]
    return sorted(out, key=lambda x: (x[2], x[1], x[0]))


def relations(pages: DataFrame, directories: Sequence[str], known: DataFrame | None = None, mentions: bool = True) -> DataFrame:
    """(subject, object, predicate, link_source, confidence, page): links between pages, once each.

    Wiki links without a directory are resolved against titles and last parts of the keys of ``known`` pages (these, by
    default) by a join; one that fits several pages is an edge to each, one that fits none is left out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, key, kind, body in zip(part["id"], part["key"], part["type"], part["body"]):
                text = blanked(body or "")
                for source, target, at in references(text, directories):
                    near = " ".join(text[max(0, at - CONTEXT // 2) : at + CONTEXT // 2].split())
                    predicate, sure = ("wikilink_basename", 1.0) if source == "wiki" else predicate_of(kind or key.split("/")[0], near)
                    out.append((i, key, slug(target) if source == "wiki" else target, predicate, "wikilink-resolved" if source == "wiki" else source, sure))
            yield pd.DataFrame(out, columns=["page", "subject", "target", "predicate", "link_source", "confidence"])

    kind = pages.schema["id"].dataType.simpleString()
    found = pages.select("id", "key", "type", "body").mapInPandas(run, f"page {kind}, subject string, target string, predicate string, link_source string, confidence double")
    tidy = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "-"), r"^-+|-+$", "")
    names = (pages if known is None else known).select("key", F.explode(F.array_distinct(F.array_compact(F.array(tidy(F.element_at(F.split("key", "/"), -1)), tidy(F.col("title")))))).alias("target")).where("target <> ''")
    wiki = F.col("link_source") == "wikilink-resolved"
    resolved = found.where(wiki).join(names, "target").withColumn("object", F.col("key")).drop("key", "target")
    every = found.where(~wiki).withColumnRenamed("target", "object").unionByName(resolved).where("object <> subject")
    if not mentions:
        every = every.where("predicate <> 'mentions'")
    return every.groupBy("subject", "object", "predicate", "link_source").agg(F.max("confidence").alias("confidence"), F.min("page").alias("page"))


def declared_facts(body: str, heading: str, length: int = 80) -> list[str]:
    """Bullets and numbered items of a section, continuation lines joined, code apart; the next heading ends it."""
    out: list[list[str]] = []
    fenced = inside = open_ = False
    for line in body.splitlines():
        if FENCE.match(line):
            fenced = not fenced
        elif fenced:
            continue
        elif m := HEADING.match(line):
            if m[2].strip("#").strip().casefold() == heading.casefold():
                inside, open_ = True, False
            elif inside:
                break
        elif inside and (m := BULLET.match(line)):
            out.append([m[1]])
            open_ = True
        elif open_ and line.strip() and line[:1].isspace():
            out[-1].append(line.strip())
        else:
            open_ = False
    whole = [" ".join(" ".join(x).split()) for x in out]
    short = [f if len(f) <= length else f[: length - 1].rstrip() + "…" for f in whole if f]
    once: dict[str, str] = {}
    for f in short:
        once.setdefault(f.casefold(), f)
    return list(once.values())


def facts(pages: DataFrame, heading: str, length: int = 80) -> DataFrame:
    """(id, key, ordinal, fact): the facts that pages declare under a heading, once each."""
    kind = pages.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [(i, k, n, f) for i, k, body in zip(part["id"], part["key"], part["body"]) for n, f in enumerate(declared_facts(body or "", heading, length), 1)]
            yield pd.DataFrame(out, columns=["id", "key", "ordinal", "fact"])

    return pages.select("id", "key", "body").mapInPandas(run, f"id {kind}, key string, ordinal int, fact string")


def fact_index(found: DataFrame, most: int = 100) -> tuple[list[str], int]:
    """The lines of an index of facts, by page key and order, and how many were left out."""
    n = found.count()
    rows = found.orderBy("key", "id", "ordinal").limit(most).collect()
    lines = ["Page facts index:"] + [f"{r['key']}: {r['fact']}" for r in rows]
    left = max(0, n - most)
    return lines + ([f"Index truncated: {left} declared facts omitted."] if left else [] if rows else ["No declared page facts."]), left


