"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tags and runs of words.  Words score by where they stand and tags
cost; a linear scan finds the contiguous region with the highest sum.  Weights are learned
from labelled pages: those that mark their content with ``article`` or ``main``; a word there
is content unless it stands in something that never is (menus, forms, adverts, comments).
A word's score is the naive-Bayes log odds of the tags and class names around it (and a little for being a word), a tag's
cost the log odds of meeting it outside content.  Counts are taken over all pages, in a
table of hashed cues, and added up map-side.

Inside the region, what stands in something that is never content is left out.  It doesn't end
the region inside content, nor anywhere on a page whose ``article`` or ``main`` holds no words.
An element is taken for such by its tag or by a whole class, id or role (``site-footer``, but not
``tag-search``); other names only are cues.  ``article`` and ``main`` never are by their names, and an
element around most of the page's content, or of its words if nothing is marked as content, is
spared.  Where a page would be left without text, names count for nothing.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillweave.llm.common import ship, whole_text

SLOTS = 4096
MOST = 4.0
#: score of a word that nothing is known about
PLAIN = 0.25
#: cost of a tag, at most, inside what a page marks as content; a word there scores at least ``PLAIN``
MARKED_COST = 0.02
CONTENT = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: contents are no text of the page
SKIPPED = frozenset("script style template iframe svg canvas title textarea select option head video audio annotation annotation-xml".split())
#: contents are raw: nothing in them is a tag but their own end
RAW = frozenset("script style textarea title iframe".split())
INLINE = frozenset(
    "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mstyle mover munder munderover mspace mpadded semantics object noscript "
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input button".split()
)
#: never content: elements, and words of class, id and role
NEVER_TAGS = frozenset("nav footer aside form button dialog menu fieldset".split())
#: those of them that some pages put around everything
AROUND_TAGS = frozenset("form fieldset aside".split())
NEVER_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary
    consent contentinfo cookie cookies dialog disqus footer form login menu modal nav navbar navigation newsletter notice
    notices pager pagination popup promo related reply replies respond search share sharing sidebar signup social sponsor
    sponsored subscribe toolbar widget""".split()
)
#: parts of a name that only say what kind of box it is on (comment-list, site-footer, ad-slot)
BOXES = frozenset(
    """area bar block body bottom box column container group inner item items left line links list main menu outer page panel post posts right
    row section site slot top unit wrap wrapper zone""".split()
)
#: only outside of content
PAGE_NAMES = frozenset("header masthead".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>")
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CLOSES_P = frozenset(
    "address article aside blockquote div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th tr ul".split()
)
_ITEMS = {"li": "li", "dd": "dt dd", "dt": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}


def _slot(cue: str) -> int:
    return zlib.crc32(cue.encode()) % SLOTS


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """Words of class, id and role, and the words of those names that say nothing else."""
    words: set[str] = set()
    said: set[str] = set()
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            parts = re.findall(r"[a-z]+", token)
            words.update(parts)
            telling = [p for p in parts if p not in BOXES or p in NEVER_NAMES]
            if all(p in NEVER_NAMES or p in PAGE_NAMES for p in telling):
                said.update(telling)
    return words, said


class Walk:
    """Items of a page in order: ``(kind, value, cues, content, vetoes)``.

    ``kind`` is ``"words"`` (value: the raw text) or ``"tag"`` (value: its name); ``cues`` are
    the distinct hashed cues around words; ``content`` tells whether content surrounds them, and
    ``vetoes`` which of the elements that are never content: numbers into ``kinds``, which tells of each
    whether it is so by its tag, and whether it may be around the content.
    """

    def __init__(self, page: str):
        self.page = page
        self.open: list[tuple[str, tuple[int, ...], bool, bool]] = []
        self.names: dict[str, int] = {}
        self.cues: dict[int, int] = {}
        self.content = 0
        self.vetoes: tuple[int, ...] = ()
        self.kinds: list[tuple[bool, bool]] = []

    def _push(self, name: str, attributes: str) -> None:
        words, said = _names(attributes) if attributes else (set(), set())
        content = name in CONTENT and not (self.content and said & NEVER_NAMES)  # a comment's article is none
        by_name = bool(said & NEVER_NAMES) or not self.content and bool(said & PAGE_NAMES)
        by_tag = name in NEVER_TAGS or not self.content and name == "header"
        # a class of the whole page says nothing, nor does one of what holds its content
        never = (by_tag or by_name) and not content and name not in ("html", "body")
        if never:
            self.vetoes += (len(self.kinds),)
            by_tag = by_tag and name not in AROUND_TAGS
            self.kinds.append((by_tag, not by_tag and not self.content))
        # a named element says what its name says; the plain tag's odds are those of plain ones
        cues = tuple({_slot(f".{w}") for w in words} or {_slot(name)})
        self.open.append((name, cues, content, never))
        self.names[name] = self.names.get(name, 0) + 1
        for c in cues:
            self.cues[c] = self.cues.get(c, 0) + 1
        self.content += content

    def _pop(self) -> str:
        name, cues, content, never = self.open.pop()
        self.names[name] -= 1
        for c in cues:
            self.cues[c] -= 1
            if not self.cues[c]:
                del self.cues[c]
        self.content -= content
        if never:
            self.vetoes = self.vetoes[:-1]
        return name

    def _close(self, name: str) -> None:
        if self.names.get(name):
            while self._pop() != name:
                pass

    def _imply(self, name: str) -> None:
        """End tags that a start tag implies."""
        if name in _CLOSES_P and self.names.get("p"):
            self._close("p")
        if name in _ITEMS:
            siblings = _ITEMS[name].split()
            for n in range(len(self.open) - 1, -1, -1):
                at = self.open[n][0]
                if at in siblings:
                    while len(self.open) > n:
                        self._pop()
                    break
                if at not in INLINE and at != "p":
                    break

    def __iter__(self) -> Iterator[tuple[str, str, tuple[int, ...], bool, tuple[int, ...]]]:
        page, at = self.page, 0
        while at < len(page):
            opens = page.find("<", at)
            if opens < 0:
                opens = len(page)
            if opens > at:
                yield "words", page[at:opens], tuple(self.cues), self.content > 0, self.vetoes
            if opens == len(page):
                return
            if page.startswith("<!--", opens):
                end = page.find("-->", opens + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            m = _TAG.match(page, opens)
            if not m:
                yield "words", "<", tuple(self.cues), self.content > 0, self.vetoes
                at = opens + 1
                continue
            at = m.end()
            end_tag, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue  # a declaration
            name = name.lower()
            if end_tag:
                self._close(name)
                yield "tag", name, (), self.content > 0, self.vetoes
                continue
            if name in SKIPPED:
                at = self._skip(name, at, attributes)
                continue
            self._imply(name)
            if name not in VOID:
                self._push(name, attributes)
            yield "tag", name, (), self.content > 0, self.vetoes

    def _skip(self, name: str, at: int, attributes: str) -> int:
        """Past the end tag of an element without text; ``head`` also ends where the body begins."""
        if attributes.rstrip().endswith("/") and name not in RAW:
            return at
        if name == "head":
            for m in re.finditer(r"</head\s*>|<body\b|<(script|style|title)\b", self.page[at:], re.I):
                if not m[1]:
                    return at + (m.end() if m[0].startswith("</") else m.start())
                rest = at + m.end()
                end = re.compile(rf"</{m[1]}\s*>", re.I).search(self.page, rest)
                if end is None:
                    return len(self.page)
                return self._skip(name, end.end(), "")
            return at
        end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, at)
        return end.end() if end else (len(self.page) if name in RAW else at)


Item = tuple[str, str, tuple[int, ...], bool, bool]


def items_of(page: str) -> tuple[list[Item], list[Item] | None]:
    """A page's items with one flag in place of the vetoes: whether one stands that nothing spares.

    Also the same with vetoes by tag only, where those by name may have left nothing.
    """
    walk = Walk(page)
    items = list(walk)
    held = [[0, 0] for _ in walk.kinds]
    total = [0, 0]
    for kind, value, _, content, vetoes in items:
        if kind == "words":
            n = len(value.split())
            total[content] += n
            for v in vetoes:
                held[v][content] += n
    marked = total[1] > 0
    # around most of what is marked as content, or, where nothing is, of all words
    spared = {v for v, (_, around) in enumerate(walk.kinds) if around and 2 * held[v][marked] > total[marked]}
    by_name = {v for v, (by_tag, _) in enumerate(walk.kinds) if not by_tag}

    def flagged(free: set[int]) -> list[Item]:
        return [(kind, value, cues, content, bool(vetoes) and not free.issuperset(vetoes)) for kind, value, cues, content, vetoes in items]

    bare = marked or not any(kind == "tag" and value in CONTENT for kind, value, *_ in items)
    return flagged(spared), flagged(by_name) if bare and by_name - spared else None


def count_cues(page: str, table: np.ndarray) -> None:
    """Adds a labelled page's words and tags to ``table``: [words around cue, words, tags] x [outside, content]."""
    items, _ = items_of(page)
    if not any(i[3] and not i[4] for i in items):
        return
    for kind, value, cues, content, never in items:
        where = int(content and not never)
        if kind == "tag":
            table[2, where, _slot(value)] += 1
        elif n := len(value.split()):
            table[1, where, 0] += n
            table[0, where, list(cues)] += n


def _odds(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log odds of content against outside, smoothed towards equal rates: 0 for what was never counted."""
    total = np.maximum(total, 1.0)
    rate = counts / total[:, None] + 1 / total.sum()
    return np.log(rate[1] / rate[0])


class Weights:
    """Log odds of content from counts; without labelled pages every word scores 1 and every tag costs 1."""

    def __init__(self, table: np.ndarray):
        around, words, tags = table.astype(np.float64)
        total = words[:, 0]
        self.learned = bool(total.all())
        self.cue = np.clip(_odds(around, total), -MOST, MOST) if self.learned else np.zeros(SLOTS)
        self.cost = np.clip(-_odds(tags, tags.sum(axis=1)), 0.1, MOST) if self.learned else np.ones(SLOTS)

    def word(self, cues: tuple[int, ...], never: bool) -> float:
        if never:
            return -MOST
        if not self.learned:
            return 1.0
        return float(np.clip(PLAIN + self.cue[list(cues)].sum(), -MOST, MOST))


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the highest sum; empty if none is positive; ties: the first."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best region, one a line, white space inside them brought to one space."""
    items, without_names = items_of(page)
    text = _region_text(items, weights)
    return text if text or without_names is None else _region_text(without_names, weights)


def _region_text(items: list[Item], weights: Weights) -> str:
    known: dict[tuple, float] = {}
    labelled = any(kind == "words" and content and not never and not value.isspace() for kind, value, _, content, never in items)
    scores = []
    for kind, value, cues, content, never in items:
        if never and (content or not labelled):
            scores.append(0.0)  # passed over: neither content nor a reason to end it
            continue
        if kind == "tag":
            cost = float(weights.cost[_slot(value)])
            scores.append(-min(cost, MARKED_COST) if content and labelled else -cost)
            continue
        if (cues, never) not in known:
            known[cues, never] = weights.word(cues, never)
        score = known[cues, never]
        scores.append(len(value.split()) * (max(score, PLAIN) if content and labelled else score))
    first, last = best_region(scores)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(text)

    for kind, value, _, _, never in items[first:last]:
        if kind == "words":
            if not never:
                held.append(value)
        elif value == "br":
            held.append(" ")
        elif value not in INLINE:
            flush()
    flush()
    return "\n".join(blocks)


def learn(pages: DataFrame, page: str = "html") -> Weights:
    """Weights from all labelled pages; the counts are a table of fixed size."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((3, 2, SLOTS), np.int64)
        for batch in batches:
            for p in batch.column(0):
                count_cues(p.as_py(), table)
        flat = table.ravel()
        at = np.nonzero(flat)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["at", "n"])

    counted = pages.select(whole_text(page).alias("_page")).mapInArrow(run, "at bigint, n bigint")
    table = np.zeros(3 * 2 * SLOTS, np.int64)
    for r in counted.groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 6 * SLOTS rows
        table[r["at"]] = r["n"]
    return Weights(table.reshape(3, 2, SLOTS))


def extract(pages: DataFrame, *, page: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``carry`` columns and ``text`` of every page's whole html.

    Null and empty pages, and pages without a positive region, have an empty text.  Repeated
    rows and null keys are extracted like any other, pages of any length whole, one at a time; of
    regions with equal sums the first is taken; other columns, whatever their names, play no part;
    an empty table gives no rows.
    """
    weights = learn(pages, page)
    fields = pages.select(*carry).schema
    types = [to_arrow_type(f.dataType) for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(p.as_py(), weights) for p in part.column(len(carry))]
                columns = [part.column(i).cast(t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*carry, "text"])

    return pages.select(*carry, whole_text(page).alias("_page")).mapInArrow(run, schema)
