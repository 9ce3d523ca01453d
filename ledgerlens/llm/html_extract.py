"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. A block has features of its ancestors (tags, words
of classes, ids and roles), of its text (length, share of link text, punctuation, marks of notices), of its neighbours and
of its container (how much of the page's running text it holds). A chain CRF with the labels "main" and "other" is trained
on labelled pages and decoded by Viterbi. The labelled pages are written by ``labelled_page``: half of them with telling
names and elements, half with plain containers, tables, sections and texts without any, in which length, links and place
must decide, among menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments.

The model is stored beside this module, as the fit of ``TRAINING_PAGES`` pages left it; ``python -m
ledgerlens.llm.html_extract`` fits and stores it again. A block's ancestors are a running sum of weights, so the work is
linear in the page whatever its nesting.

Defined cases: null and empty html give an empty text; unclosed, crossed and truncated tags are closed where a browser
would close them; scripts, styles and other raw elements have no text, to the end of the page if they are unclosed;
pages without a main block give an empty text; repeated rows give repeated results; null ids and urls are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import json
import math
import random
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame

from ledgerlens.llm import common

TRAINING_PAGES, EPOCHS, SEED = 2400, 20, 11
STORED = Path(__file__).with_name("html_model.json")

# HTML elements by their role in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead pre ul ol dl table blockquote header hgroup".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIER = frozenset("ul ol dl table select menu".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Words of notices, adverts, menus and footers in the languages of the pages.
MARKS = re.compile(
    r"©|\bcopyright\b|\ball rights reserved\b|\bcookies?\b|\bsubscribe\b|\bnewsletter\b|\badvert|\bsponsored\b|\blog ?in\b|\bsign (?:in|up)\b|\bshare\b|\bprivacy\b|\bterms of\b|\bfollow us\b"
    r"|\bimpressum\b|\bdatenschutz|\banmelden\b|\bwerbung\b|\banzeige\b|\bmentions légales\b|\bpublicité\b|\baviso legal\b|\bpublicidad\b|\bsuscr",
    re.I,
)
RELATED = re.compile(r"\brepl(?:y|ies)\b|\bcomments?\b|\bresponses\b|\brelated\b|\bmore (?:from|stories|articles)\b|\bread (?:more|also|next)\b|\bkommentare?\b|\bmehr zum thema\b|\bcommentaires?\b|\bcomentarios?\b|\brelacionad|\bà lire aussi\b", re.I)


class Leaf:
    """A leaf block: its text, its ancestors' features or the sum of their weights, and the share of its characters in links."""

    __slots__ = ("base", "box", "links", "names", "tag", "text")

    def __init__(self, text: str, names: list[str], base: float, links: float, tag: str, box: int) -> None:
        self.text, self.names, self.base, self.links, self.tag, self.box = text, names, base, links, tag, box


def attribute_names(raw: str) -> list[str]:
    """Features of a tag's attributes."""
    out = []
    for m in ATTRIBUTE.finditer(raw):
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind == "hidden":
            out.append("hidden")
        else:
            out += [f"{'role' if kind == 'role' else 'name'}:{x}" for x in NAME.findall(CAMEL.sub(" ", value).lower())[:12]]
    return out


class Open:
    """The open elements of a page, with what a leaf needs to know of them at hand."""

    def __init__(self, weights: dict[str, float] | None) -> None:
        self.weights = weights
        self.stack: list[tuple[str, list[str], str, int, list[str]]] = []  # tag, names, innermost block, container, its names
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.active: Counter = Counter()
        self.base, self.boxes = 0.0, 1

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def push(self, tag: str, names: list[str]) -> None:
        _, _, block, box, near = self.stack[-1] if self.stack else ("", [], "body", 0, [])
        if tag in BLOCK:
            block = tag
            if tag not in TEXTUAL:
                box, near, self.boxes = self.boxes, names, self.boxes + 1
        if self.weights is not None:
            names = [n for n in names if n in self.weights]
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BARRIER:
            self.barriers.append(len(self.stack))
        self.stack.append((tag, names, block, box, near))
        for n in names:
            self.active[n] += 1
            if self.active[n] == 1 and self.weights is not None:
                self.base += self.weights[n]

    def pop(self) -> str:
        tag, names, *_ = self.stack.pop()
        self.places[tag].pop()
        if tag in BARRIER:
            self.barriers.pop()
        for n in names:
            self.active[n] -= 1
            if not self.active[n]:
                del self.active[n]
                if self.weights is not None:
                    self.base -= self.weights[n]
        if not self.active:
            self.base = 0.0  # no rounding is carried on
        return tag

    def close_until(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def leaf(self, text: str, links: float) -> Leaf:
        _, _, block, box, near = self.stack[-1] if self.stack else ("", [], "body", 0, [])
        near = ["near-" + n for n in near[:24]]
        if self.weights is None:
            return Leaf(text, [*self.active, *near], 0.0, links, block, box)
        return Leaf(text, [], self.base + sum([self.weights.get(n, 0.0) for n in near]), links, block, box)


def leaves(page: str, weights: dict[str, float] | None = None) -> list[Leaf]:
    """The leaf blocks of a page, in page order. Linear in the page. With ``weights`` ancestors are summed, not listed."""
    out: list[Leaf] = []
    opened = Open(weights)
    text: list[str] = []
    size = linked = 0

    def flush() -> None:
        nonlocal size, linked
        words = " ".join(html.unescape("".join(text)).split()) if text else ""
        if words:
            out.append(opened.leaf(words, linked / max(1, size)))
        text.clear()
        size = linked = 0

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece:
            text.append(piece)
            size += len(piece)
            if opened.has("a"):
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                flush()
            if opened.has(tag):
                if tag not in BLOCK and any(x[0] in BLOCK for x in opened.stack[-8:]) and all(x[0] != tag for x in opened.stack[-8:]):
                    continue  # an inline end tag whose start is outside of this block
                opened.close_until(tag)
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if opened.has("p"):
                opened.close_until("p")
            for other in CLOSES.get(tag, ()):
                if opened.has(other) and (not opened.barriers or opened.places[other][-1] > opened.barriers[-1]):
                    opened.close_until(other)
        elif tag == "br":
            text.append(" ")
        if tag in VOID or rest.rstrip().endswith("/"):
            continue
        known = tag in BLOCK or tag in INLINE
        opened.push(tag, ([f"tag:{tag}"] if known else []) + (attribute_names(rest) if rest else []))
    flush()
    return out


#: Inline elements.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())


def size_class(words: int) -> int:
    return min(8, words.bit_length())


def features(blocks: list[Leaf]) -> list[list[str]]:
    """Feature names of each block, besides those of its ancestors."""
    words = [b.text.count(" ") + 1 for b in blocks]
    kinds = ["links" if b.links > 0.6 else "prose" if n > 9 and b.links < 0.3 else "short" for b, n in zip(blocks, words)]
    marks = [("marks" if MARKS.search(b.text) else "related" if n < 12 and RELATED.search(b.text) else "") if len(b.text) < 400 else "" for b, n in zip(blocks, words)]
    held: Counter = Counter()
    for b, n, k in zip(blocks, words, kinds):
        if k == "prose":
            held[b.box] += n
    most, total = max(held.values(), default=0), sum(held.values())
    heading = next((i for i, b in enumerate(blocks) if b.tag == "h1"), None)
    out, after_related = [], {}
    for i, (b, n, k, mark) in enumerate(zip(blocks, words, kinds, marks)):
        share = round(4 * held[b.box] / total) if total else 0
        tag = b.tag if b.tag in BLOCK else "body"
        before = kinds[i - 1] if i else "first"
        after = kinds[i + 1] if i + 1 < len(blocks) else "last"
        names = [
            f"own:{tag}",
            f"words:{size_class(n)}",
            f"links:{round(b.links * 4)}",
            f"end:{'stop' if b.text[-1] in '.!?…。' else 'other'}",
            f"kind:{k},{before},{after}",
            f"own:{tag},{k}",
            f"box:{share},{k}",
            f"box:{share},{tag}",
            f"boxmost:{held[b.box] == most and most > 0},{k},{tag in TEXTUAL}",
            f"next:{blocks[i + 1].tag if i + 1 < len(blocks) else 'last'},{tag}",
            f"place:{4 * i // len(blocks)},{k}",
            f"title:{'none' if heading is None else 'before' if i < heading else 'at' if i == heading else 'after'},{k}",
            f"page:{size_class(total)},{k}",
        ]
        if mark:
            names += [mark, f"{mark},{k}"]
            if mark == "related" and k != "prose":
                after_related[b.box] = True
        elif b.box in after_related:
            names.append(f"after-related,{k}")
        if i and marks[i - 1]:
            names.append(f"after-{marks[i - 1]}")
        out.append(names)
    return out


class ChainCRF:
    """Two labels; one weight a feature for the label 1, and weights for the label pairs of neighbours."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.bias = 0.0
        self.pair = [[0.0, 0.0], [0.0, 0.0]]

    def unary(self, names: list[str], base: float = 0.0) -> float:
        get = self.weights.get
        return self.bias + base + sum([get(n, 0.0) for n in names])

    def marginals(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Probability of label 1 at each place, and expected counts of label pairs."""
        pair, n = self.pair, len(scores)
        e = [[math.exp(pair[a][b]) for b in (0, 1)] for a in (0, 1)]
        s = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in scores]
        own = [(1 - x, x) for x in s]
        forward, scale = [], []
        for k, o in enumerate(own):
            f = o if k == 0 else tuple(o[b] * (forward[-1][0] * e[0][b] + forward[-1][1] * e[1][b]) for b in (0, 1))
            z = f[0] + f[1]
            scale.append(z)
            forward.append((f[0] / z, f[1] / z))
        back = [(1.0, 1.0)] * n
        for k in range(n - 2, -1, -1):
            o, nxt, z = own[k + 1], back[k + 1], scale[k + 1]
            back[k] = tuple((e[a][0] * o[0] * nxt[0] + e[a][1] * o[1] * nxt[1]) / z for a in (0, 1))
        ones = [f[1] * b[1] for f, b in zip(forward, back)]
        pairs = [[0.0, 0.0], [0.0, 0.0]]
        for k in range(1, n):
            for a in (0, 1):
                for b in (0, 1):
                    pairs[a][b] += forward[k - 1][a] * e[a][b] * own[k][b] * back[k][b] / scale[k]
        return ones, pairs

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 1.0, decay: float = 1e-4) -> None:
        """Stochastic gradient ascent on the conditional likelihood, with adaptive step sizes."""
        seen: dict[str, float] = {}
        rng = random.Random(SEED)
        order = list(range(len(pages)))
        for epoch in range(epochs):
            rng.shuffle(order)
            step = rate / (1 + epoch)
            for p in order:
                names, labels = pages[p]
                if not labels:
                    continue
                ones, pairs = self.marginals([self.unary(x) for x in names])
                for x, y, q in zip(names, labels, ones):
                    g = y - q
                    if abs(g) < 1e-4:
                        continue
                    self.bias += 0.05 * step * g
                    for n in x:
                        seen[n] = seen.get(n, 1e-2) + g * g
                        w = self.weights.get(n, 0.0)
                        self.weights[n] = w + step * (g - decay * w) / math.sqrt(seen[n])
                for a in (0, 1):
                    for b in (0, 1):
                        true = sum(1 for u, v in zip(labels, labels[1:]) if (u, v) == (a, b))
                        self.pair[a][b] += 0.02 * step * (true - pairs[a][b])

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi."""
        if not scores:
            return []
        best, back = (0.0, scores[0]), []
        for s in scores[1:]:
            pick = [0 if best[0] + self.pair[0][b] >= best[1] + self.pair[1][b] else 1 for b in (0, 1)]
            best = (best[pick[0]] + self.pair[pick[0]][0], best[pick[1]] + self.pair[pick[1]][1] + s)
            back.append(pick)
        label = int(best[1] > best[0])
        path = [label]
        for pick in reversed(back):
            label = pick[label]
            path.append(label)
        return path[::-1]


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its main blocks: what the CRF is trained on."""
    return plain_page(rng) if rng.random() < 0.5 else telling_page(rng)


def telling_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page whose elements and names tell what they hold. Words are invented, so that layout and form must decide."""
    syllables = ["ka", "re", "mon", "ti", "sul", "der", "in", "os", "pra", "li", "chen", "é", "ño", "va", "th"]

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def words(low: int, high: int, stop: str = ".") -> str:
        w = [word() for _ in range(rng.randint(low, high))]
        if rng.random() < 0.15:
            w = [x + rng.choice(["###", "$$$", "!!", "%%%"]) for x in w]
        if rng.random() < 0.08:
            w = [x.upper() for x in w]
        return (" ".join(w)).capitalize() + stop

    def sentence_text() -> str:
        return " ".join(words(1, 18, rng.choice([".", ".", ".", "", ","])) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))) + rng.choice(["", ".", "."])

    def name(options: str) -> str:
        x = rng.choice(options.split("|"))
        kind = rng.random()
        return f' class="{x}"' if kind < 0.6 else f' id="{x}"' if kind < 0.8 else f' class="{word()} {x}"'

    main: list[str] = []

    def keep(text: str) -> str:
        main.append(" ".join(text.split()))
        return html.escape(text, quote=False) if rng.random() < 0.9 else html.escape(text)

    def links(n: int, wrap: str = "li") -> str:
        return "".join(f'<{wrap}><a href="/{word()}">{words(1, 4, "")}</a></{wrap}>' for _ in range(n))

    def menu() -> str:
        inner = f"<ul>{links(rng.randint(2, 9))}</ul>" if rng.random() < 0.7 else links(rng.randint(2, 7), rng.choice(["span", "div"]))
        return rng.choice([f"<nav>{inner}</nav>", f"<nav{name('menu|main-nav|navbar|breadcrumb')}>{inner}</nav>", f"<div{name('menu|nav|navigation|navbar|topbar|breadcrumbs|top-menu')}>{inner}</div>", f'<div role="navigation">{inner}</div>'])

    def advert() -> str:
        own = rng.choice([sentence_text(), f'<a href="#">{words(2, 12)}</a>', f"<p>{sentence_text()}</p>"])
        return f"<!-- ad {rng.randint(0, 99)} -->" * (rng.random() < 0.3) + rng.choice([f'<div class="ad">{own}</div>', f"<div{name('ad|ads|advert|advertisement|banner|sponsored|promo|ad-slot|adsbox')}>{own}</div>", f"<aside{name('ad|promo|sponsored')}>{own}</aside>", f"<ins{name('ads|adsbygoogle|ad')}><div>{own}</div></ins>"])

    def notice() -> str:
        return f"<div{name('cookie-notice|cookie-banner|consent|notice|alert|gdpr|cookies|site-notice|popup|modal|newsletter|paywall')}>" + rng.choice([f"<p>{sentence_text()}</p>", sentence_text(), f"{sentence_text()}<button>{words(1, 2, '')}</button>"]) + "</div>"

    def form() -> str:
        return f"<form{name('search|login|newsletter|contact|subscribe')}>" + rng.choice(["", f"<label>{words(1, 4, ':')}</label>", f"<p>{sentence_text()}</p>"]) + f'<input name="q"><button>{words(1, 2, "")}</button>' + rng.choice(["", f"<select><option>{word()}<option>{word()}</select>"]) + "</form>"

    def comments() -> str:
        each = "".join(rng.choice([f'<div class="comment"><b>{word()}</b><p>{sentence_text()}</p></div>', f"<li><cite>{word()}</cite> {sentence_text()}</li>", f'<article class="comment"><p>{sentence_text()}</p></article>', f'<p class="comment-body">{sentence_text()}</p>']) for _ in range(rng.randint(1, 6)))
        head = rng.choice(["", f"<h2>{words(1, 2, '')}</h2>", "<h3>Comments</h3>"])
        return rng.choice([f"<section{name('comments|reader-comments|responses|discussion|comment-list|disqus_thread|replies')}>{head}{each}</section>", f"<div{name('comments|comment-section|reader-comments|comment-list|responses')}>{head}{each}</div>", f"<ol{name('comments|commentlist')}>{each}</ol>"])

    def sidebar() -> str:
        inner = rng.choice([f"<h3>{words(1, 3, '')}</h3><ul>{links(rng.randint(2, 6))}</ul>", f"<p>{sentence_text()}</p>", f"<div>{sentence_text()}</div>", f"<h4>{words(1, 4, '')}</h4><p>{sentence_text()}</p>"])
        return rng.choice([f"<aside>{inner}</aside>", f"<aside{name('sidebar|related|widget')}>{inner}</aside>", f"<section{name('related|more|recommended')}>{inner}</section>", f"<div{name('sidebar|side-bar|widget|related|related-posts|recommended|trending|side|rail')}>{inner}</div>"])

    def share() -> str:
        return f"<div{name('share|social|tools|tags|byline|meta|share-bar')}>" + rng.choice([f"<span>{words(1, 3, '')}</span>", links(3, "span")]) + "</div>"

    def head() -> str:
        inner = rng.choice([f"<h1>{words(1, 4, '')}</h1>", f'<a href="/">{words(1, 3, "")}</a>', f"<div>{words(1, 6, '')}</div>", f"<p>{words(2, 8)}</p>"])
        return rng.choice([f"<header>{inner}{menu() if rng.random() < 0.4 else ''}</header>", f"<div{name('header|site-header|masthead|page-header|top')}>{inner}</div>"])

    def foot() -> str:
        inner = rng.choice([f"&copy; {word()}.example &middot; {sentence_text()}", f"<p>{sentence_text()}</p>", f"<ul>{links(4)}</ul>", f"<p>Copyright {word()}. All rights reserved.</p>", f"<div>{sentence_text()}</div>{menu()}"])
        return rng.choice([f"<footer>{inner}</footer>", f"<footer{name('footer|site-footer')}>{inner}</footer>", f"<div{name('footer|site-footer|bottom|copyright|colophon')}>{inner}</div>"])

    def inner_blocks() -> str:
        out = []
        title = words(2, 12, "")
        if rng.random() < 0.9:
            tag = rng.choice(["h1", "h1", "h1", "h2"])
            kept = keep(title)
            out.append(rng.choice([f"<{tag}>{kept}</{tag}>", f"<{tag}>{kept}</{tag}>", f"<header><{tag}>{kept}</{tag}></header>"]))
        for k in range(rng.choice([1, 2, 3, 5, 8, 14])):
            kind = rng.random()
            t = sentence_text()
            if k == 0 and rng.random() < 0.5:
                out.append(f"<p><b>{keep(title + ' ' + t)}<br>")
            elif kind < 0.72:
                kept = keep(t)
                out.append(rng.choice([f"<p>{kept}</p>", f"<p>{kept}</p>", f"<p>{kept}", f"<div>{kept}</div>", f"<p{name('text|para|lead|intro')}>{kept}</p>"]))
            elif kind < 0.8:
                out.append((lambda n: f"<h{n}>{keep(words(1, 6, ''))}</h{n}>")(rng.choice("234")))
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{keep(words(1, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote>{keep(t)}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{keep(t)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{keep(words(1, 5, ''))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.96:
                out.append(f"<pre>{keep(t)}</pre>")
            else:
                t1, w, t2 = words(3, 9, ""), words(1, 3, ""), words(2, 9)
                keep(f"{t1} {w} {t2}")
                out.append(f'<p>{html.escape(t1)} <a href="/x">{html.escape(w)}</a> {html.escape(t2)}</p>')
            if rng.random() < 0.12:
                out.append(rng.choice([advert, share, sidebar, notice, form, menu])())
            if rng.random() < 0.04:  # such words are text as well where they stand in the article itself
                out.append(f"<p>{keep(rng.choice(['All rights reserved.', 'Share and enjoy.', 'No cookies were left.', 'Copyright law is old.', 'See the privacy rules.']))}</p>")
        if rng.random() < 0.15:
            out.append(rng.choice([comments, share])())
        return "".join(out)

    def article() -> str:
        inner = inner_blocks()
        kind = rng.random()
        if kind < 0.45:
            return f"<article>{inner}</article>"
        if kind < 0.6:
            return f"<article{name('post|entry|story|hentry')}>{inner}</article>"
        if kind < 0.75:
            if rng.random() < 0.3:
                inner = f"<section>{inner}</section>" + "".join(f"<section>{inner_blocks()}</section>" for _ in range(rng.randint(0, 2)))
            return rng.choice([f"<main>{inner}</main>", f"<main><article>{inner}</article></main>", f"<main><div>{inner}</div></main>"])
        return f"<div{name('content|post|entry-content|article|article-body|main-content|story|post-content|text|body|main|page-content')}>{inner}</div>"

    before = [f() for f in rng.sample([menu, menu, head, advert, notice, form, sidebar, advert], rng.randint(0, 4))]
    body = article()
    after = [f() for f in rng.sample([foot, foot, comments, comments, sidebar, advert, notice, form, share, menu], rng.randint(0, 5))]
    inside = "".join(before) + body + "".join(after)
    if rng.random() < 0.25:
        inside = f"<div{name('page|wrapper|container|site|layout')}>{inside}</div>"
    return f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{inside}</body></html>", main


def plain_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page without telling names: plain containers, layout tables, sections and paragraphs side by side."""
    syllables = "ba ko lin tra mes ur dis pen fo gra sti al mo ve nu ker sa ti en ro".split()
    main: list[str] = []

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize()

    def sentences(low: int, high: int) -> str:
        return " ".join(words(5, 16) + rng.choice([".", ".", ".", "?", ", " + word() + "."]) for _ in range(rng.randint(low, high)))

    def name() -> str:
        return rng.choice(["", "", "", f' class="{word()}"', f' id="{word()}"', f' class="{word()} {word()}"', ' style="margin:0"'])

    def keep(text: str) -> str:
        main.append(" ".join(text.split()))
        return html.escape(text, quote=False)

    def link(text: str) -> str:
        return f'<a href="/{word()}">{text}</a>'

    def box(inner: str) -> str:
        tag = rng.choice(["div", "div", "div", "section", "center"])
        return f"<{tag}{name()}>{inner}</{tag}>"

    def menu() -> str:
        found = [link(words(1, 3)) for _ in range(rng.randint(2, 9))]
        return rng.choice([box("<ul>" + "".join(f"<li>{x}" for x in found) + "</ul>"), box(rng.choice([" ", " | ", " &middot; "]).join(found)), "<p>" + " | ".join(found) + "</p>", "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>", "<table><tr>" + "".join(f"<td>{x}</td>" for x in found) + "</tr></table>"])

    def banner() -> str:
        return rng.choice([box(link(words(1, 3))), box(words(1, 4)), f"<div><img src=x>{words(1, 3)}</div>", box(f"<b>{words(1, 3)}</b>"), f"<p>{link(words(1, 3))}</p>"])

    def foot() -> str:
        said = rng.choice([f"&copy; {rng.randint(1999, 2025)} {words(1, 3)}", f"Copyright {words(1, 2)}. All rights reserved.", f"{words(1, 2)}. All rights reserved", f"© {words(1, 2)} · Impressum · Datenschutz"])
        return rng.choice([box(said), f"<p>{said}</p>", f"<hr><small>{said}</small>", box(f"<p>{said}</p><p>{link('Privacy policy')} {link('Terms of use')}</p>"), box(menu() + f"<p>{said}</p>")])

    def side() -> str:
        head = rng.choice(["Related articles", "More stories", "Read next", "Mehr zum Thema", words(1, 3), words(1, 3)])
        own = "<ul>" + "".join(f"<li>{link(words(2, 8))}</li>" for _ in range(rng.randint(2, 7))) + "</ul>"
        return rng.choice([box(f"<h3>{head}</h3>{own}"), box(f"<b>{head}</b>{own}"), f"<h3>{head}</h3>{own}", box(f"<h4>{head}</h4><p>{words(4, 9)}</p>")])

    def advert() -> str:
        return rng.choice([box("Advertisement"), box(f"Sponsored: {words(3, 9)}"), box(f"<p>Advertisement</p>{link(words(3, 9))}"), box(link(words(3, 12))), box(f"Anzeige<br>{link(words(2, 8))}")])

    def notice() -> str:
        said = rng.choice([f"We use cookies to {words(3, 9).lower()}.", f"This site uses cookies. {sentences(1, 1)}", f"Subscribe to our newsletter. {words(2, 6)}", f"Sign up and {words(3, 8).lower()}.", "Please log in to continue."])
        return rng.choice([box(said), box(f"<p>{said}</p><button>{words(1, 1)}</button>"), box(f"{said} {link('Accept')}")])

    def share() -> str:
        return rng.choice([box("Share this: " + " ".join(link(x) for x in ("Facebook", "Twitter", "Mail"))), box(" ".join(link(x) for x in ("Share", "Print", "Mail"))), "<p>Follow us: " + link(words(1, 1)) + "</p>"])

    def form() -> str:
        return f'<form action="/{word()}"><label>{words(1, 3)}</label><input name=q><button>{words(1, 1)}</button></form>'

    def comments() -> str:
        head = rng.choice(["Comments", f"{rng.randint(1, 90)} comments", "Responses", "Kommentare", "Leave a reply", "Commentaires", "Comentarios"])
        each = [rng.choice([f"<div{name()}><b>{words(1, 2)}</b><p>{sentences(1, 3)}</p></div>", f"<p>{words(1, 2)}: {sentences(1, 3)}</p>", f"<div><p>{sentences(1, 2)}</p>{link('Reply')}</div>"]) for _ in range(rng.randint(1, 5))]
        return box(f"<h{rng.choice('234')}>{head}</h3>" + "".join(each))

    def paragraphs(n: int, own_names: str) -> str:
        out = []
        for _ in range(n):
            kind = rng.random()
            if kind < 0.76:
                t = sentences(1, 6) if rng.random() < 0.85 else words(2, 8) + "."
                if rng.random() < 0.25:
                    t1, w, t2 = sentences(1, 2), words(1, 3), sentences(1, 2)
                    main.append(f"{t1} {w} {t2}")
                    out.append(f"<p{own_names}>{t1} {link(w)} {t2}</p>")
                else:
                    kept = keep(t)
                    out.append(rng.choice([f"<p{own_names}>{kept}</p>", f"<p>{kept}"]) if rng.random() < 0.85 else f"<div{own_names}>{kept}</div>")
            elif kind < 0.84:
                out.append((lambda h: f"<h{h}>{keep(words(1, 7))}</h{h}>")(rng.choice("234")))
            elif kind < 0.92:
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{keep(words(1, 9) if rng.random() < 0.5 else sentences(1, 2))}</li>" for _ in range(rng.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.96:
                out.append(f"<blockquote>{keep(sentences(1, 2))}</blockquote>")
            else:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{keep(words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            if rng.random() < 0.05:
                out.append(rng.choice([advert, share, side])())
        return "".join(out)

    def part(level: str) -> str:
        head = f"<h{level}>{keep(words(1, 9))}</h{level}>" if rng.random() < 0.9 else ""
        if rng.random() < 0.12:  # a page of a few words
            return head + "".join(f"<p>{keep(words(1, 4) + '.')}</p>" for _ in range(rng.randint(1, 3)))
        return head + paragraphs(rng.choice([1, 2, 2, 3, 5, 9]), rng.choice(["", "", "", name()]))

    def body() -> str:
        kind = rng.random()
        if kind < 0.3:
            return box(part("1"))
        if kind < 0.45:
            return part("1")
        if kind < 0.6:
            return "".join(box(part(rng.choice("123"))) for _ in range(rng.randint(1, 4)))
        if kind < 0.72:
            wrap = rng.choice(["main", "div", "article", "div"])
            inner = "".join(f"<section{name()}>{part(rng.choice('23'))}</section>" for _ in range(rng.randint(1, 4)))
            return f"<{wrap}>{inner}{side() if rng.random() < 0.3 else ''}</{wrap}>"
        if kind < 0.86:
            cells = [f"<td{name()}>{rng.choice([menu, side, advert])()}</td>", f"<td{name()}>{part('1')}</td>"]
            if rng.random() < 0.4:
                cells.append(f"<td>{rng.choice([side, advert, menu])()}</td>")
            return f"<table{name()}><tr>{''.join(cells)}</tr></table>"
        return box(box(part("1")) + (side() if rng.random() < 0.4 else ""))

    before = "".join(rng.choice([menu, banner, banner, notice, advert, form, menu])() for _ in range(rng.randint(0, 4)))
    inner = before + body() + "".join(rng.choice([foot, foot, comments, side, share, advert, notice, form, menu])() for _ in range(rng.randint(0, 4)))
    if rng.random() < 0.3:
        inner = box(inner)
    return f"<html><head><title>{words(1, 4)}</title></head><body>{inner}</body></html>", main


def labels_of(blocks: list[Leaf], main: list[str]) -> list[int]:
    """1 for each block that is a main block of a labelled page."""
    left, out = Counter(main), []
    for b in blocks:
        out.append(int(left[b.text] > 0))
        left[b.text] -= out[-1]
    return out


def train() -> ChainCRF:
    """The CRF, trained on ``TRAINING_PAGES`` labelled pages; the same each time. Names of under 5 pages are left out."""
    rng = random.Random(SEED)
    pages, seen = [], Counter()
    for _ in range(TRAINING_PAGES):
        page, main = labelled_page(rng)
        blocks = leaves(page)
        names = [b.names + f for b, f in zip(blocks, features(blocks))]
        seen.update({n for x in names for n in x})
        pages.append((names, labels_of(blocks, main)))
    crf = ChainCRF()
    crf.fit([([[n for n in x if seen[n] >= 5] for x in names], labels) for names, labels in pages])
    return crf


def store(crf: ChainCRF, path: Path = STORED) -> None:
    made = {"bias": round(crf.bias, 4), "pair": [[round(x, 4) for x in r] for r in crf.pair], "weights": {n: round(w, 4) for n, w in sorted(crf.weights.items())}}
    path.write_text(json.dumps(made, ensure_ascii=False, indent=0) + "\n")


@functools.cache
def model() -> ChainCRF:
    """The stored CRF."""
    made, crf = json.loads(STORED.read_text()), ChainCRF()
    crf.bias, crf.pair, crf.weights = made["bias"], made["pair"], made["weights"]
    return crf


def main_text(page: str | None, crf: ChainCRF) -> str:
    """The main blocks of a page, joined by line feeds."""
    blocks = leaves(page or "", crf.weights)
    labels = crf.decode([crf.unary(x, b.base) for x, b in zip(features(blocks), blocks)])
    return "\n".join(b.text for b, y in zip(blocks, labels) if y)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with text and n_chars."""
    sent = df.sparkSession.sparkContext.broadcast(model())  # one weight a feature of the training pages

    def each():
        def work(columns: dict[str, list]) -> dict[str, list]:
            texts = [main_text(x, sent.value) for x in columns[html_col]]
            return columns | {"text": texts, "n_chars": [len(x) for x in texts]}

        return work

    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return common.map_rows(df.select(*keep, html_col), f"{kept}text string, n_chars long", each)


if __name__ == "__main__":
    store(train())
