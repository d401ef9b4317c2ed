"""Pages as sequences of text blocks, with what a labeller sees of each block."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Elements that do not end a block, elements without content, elements whose text is never shown.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script|style|template|noscript|title|textarea|select|svg|iframe|object"
#: Elements that an open paragraph ends with.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

#: Names that mark what is not the article.
OUTSIDE = frozenset("nav menu header footer aside sidebar form ad ads advert advertisement banner promo sponsor sponsored cookie consent notice alert popup modal newsletter subscribe signup comment comments reply replies disqus respond related recommended share social breadcrumb breadcrumbs pagination pager copyright legal login search widget toolbar dialog".split())

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)
      | <(?P<hidden>{HIDDEN})\b[^>]*(?:>.*?(?:</(?P=hidden)\s*>|\Z)|\Z)
      | <(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)>
      | </?[a-zA-Z!?][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|hidden|aria-label)\s*=?\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*))""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

#: Of more open elements than this, a block's `path` has the innermost, for reading; what the labeller sees covers all.
DEPTH = 256

#: Sizes of the hashed vectors: tag path, words; then plain measures.
PATHS, WORDS, MEASURES = 256, 128, 10
WIDTH = PATHS + WORDS + MEASURES


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int
    buckets: frozenset[int] = frozenset()
    inside: bool = False
    outside: bool = False


class Open:
    """Running counts of the names of all open elements: their buckets, the article or main elements, and names of OUTSIDE."""

    def __init__(self):
        self.count, self.buckets, self.inside, self.outside = [0] * PATHS, set(), 0, 0

    def add(self, names: tuple[str, ...], by: int) -> None:
        for x in names:
            i = _bucket(x, PATHS)
            self.count[i] += by
            if self.count[i]:
                self.buckets.add(i)
            else:
                self.buckets.discard(i)
            self.inside += by * (x in ("article", "main"))
            self.outside += by * (x.lstrip(".") in OUTSIDE)


@lru_cache(1 << 16)
def _names(rest: str) -> tuple[str, ...]:
    return tuple("." + p.lower() for m in _NAMES.finditer(rest) for v in m.groups() if v for p in _PARTS.findall(v))


def blocks(page: str | None) -> list[Block]:
    """The page's text in order, cut where an element that is not inline begins or ends."""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = 0
    path: tuple[str, ...] = ()
    around, seen = Open(), (frozenset(), False, False)
    count: Counter[str] = Counter()
    at, page = 0, page or ""

    def end() -> None:
        nonlocal linked
        if text := " ".join("".join(parts).split()):
            out.append(Block(text, path, linked, *seen))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked, path, seen
        if raw:
            if not parts:
                path = tuple(x for _, names in open_[-DEPTH:] for x in names)
                seen = frozenset(around.buckets), around.inside > 0, around.outside > 0
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if links:
                linked += len(raw.strip())

    def close() -> str:
        tag, names = open_.pop()
        count[tag] -= 1
        around.add(names, -1)
        return tag

    for m in _TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if tag == "br":
            if parts:
                parts.append(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if m["close"] else 1
        else:
            end()
            if m["close"]:
                while count[tag]:
                    if close() == tag:
                        break
            else:
                if tag in ENDS_P and open_ and open_[-1][0] == "p" or tag == "li" and open_ and open_[-1][0] == "li":
                    close()
                if tag not in VOID and not m["rest"].endswith("/"):
                    open_.append((tag, (tag, *_names(m["rest"]))))
                    count[tag] += 1
                    around.add(open_[-1][1], 1)
    say(page[at:])
    end()
    return out


@lru_cache(1 << 16)
def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


def features(page: list[Block]) -> np.ndarray:
    """One row per block: hashed tag path, hashed words, and measures of length, links, place and of marks in the path."""
    x = np.zeros((len(page), WIDTH), np.float32)
    for i, b in enumerate(page):
        x[i, list(b.buckets)] = 1
        words = b.text.split(" ")
        x[i, PATHS : PATHS + WORDS] = np.bincount([_bucket(w.lower(), WORDS) for w in words], minlength=WORDS) / len(words)
        n = len(b.text)
        x[i, PATHS + WORDS :] = (1, min(n, 1000) / 1000, np.log1p(n) / 10, b.linked / n, i / len(page), b.text.count(" ") / n, b.text[-1] in ".!?…", len(page) / (len(page) + 20), b.inside, b.outside)
    return x
