"""HTML extraction by host suffix arrays.

1. Pages are dealt by host; the pages of a large host are dealt on into bundles of about ``bundle_bytes`` by a hash, so that no
   task holds a whole host. Each page becomes its text blocks in page order and a stream of word tokens with a mark at
   every block's edge. A block's *slot* is its place in the markup: the outermost elements around it with their classes.
2. The streams of a bundle are concatenated into a suffix array with common prefix lengths (prefix doubling; from ``RUN`` tokens on only suffixes
   that still share their prefix are sorted further). It gives the maximal runs that stand on different pages, their lengths and on how many
   pages they stand; copies of a page count once.
3. The runs are evidence on slots: a template's text repeats on the other pages of its host, the more of them there are, a page's own
   text seldom does. Each page with a slot adds the log ratio of the two likelihoods of the share of its text there that runs cover.
   The sums of a slot in the host and in all hosts, both bounded, and a prior from the markup decide whether the slot is boilerplate; all of
   its text goes, repeated or not. The prior is weak for class names and for text beside an article. Elements that are no main text by
   the standard (menus, footers, asides) and what cannot repeat because it differs on each page (forms, reader comments,
   lists of related pages) go by markup alone, and an article's own slot stays.
4. In the slots that stay, covered text goes and unique runs stay: without an article, lines that stand on two different pages and prose that stands on a
   share of the host's different pages; in an article, runs on half of its host's different pages (of 20 at least) that are not the
   better part of the article itself. Articles that are copied to other pages therefore stay whole.
5. All counts are the host's, so the results do not depend on ``bundle_bytes``: where a host has several bundles, its different pages are dealt into as
   many classes by their digests, and what the classes count adds up. For evidence each class is told which runs of its doubtful text others have. In an
   article only runs matter that half of the pages hold: each class takes the runs of a quarter of its pages from a suffix array of its own, and where their sum does
   not decide, the run is counted exactly. Runs that touch other text that stays are all counted exactly, by their hashes, over all text of the host.

The kept blocks are joined in page order by a blank line; character references are decoded once, white space in a block is
one blank.

Defined results. Null, empty or textless html: empty text. Null url, or one without a host: pages of the empty host. Cut-off
tags, comments and references at the end of a page, unclosed and wrongly nested elements are read as browsers do, roughly.
Repeated rows are extracted alike. Extra columns are ignored; an empty table gives an empty result. A page that is alone on its host repeats nothing:
there the prior and other hosts' evidence decide.
"""

from __future__ import annotations

import html as html_lib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm._common import Scratch
from chunkloom.llm.url_filter import host_of

RUN = 8  # tokens of the shortest repeated run
BUNDLE_BYTES = 2 << 20
PROSE_WORDS = 25  # a block of so many words is prose, and is boilerplate only if it repeats on ...
PROSE_SHARE = 0.1  # ... this share of the host's different pages
COVERED = 0.8  # share of a block's words from which all of it goes

ARTICLE_PAGES, ARTICLE_SHARE = 20, 0.5  # a run in articles is boilerplate on so many different pages, and so large a share of them
CHANCE = 0.03  # share of a page's own text that repeats by chance or as a copy
SEEN_AT = 100  # different pages among which half of a template's text is expected to repeat
HOST_BOUND, ALL_BOUND = 2.0, 1.2  # of a slot's evidence in its host, and in other hosts
NEUTRAL, BESIDE, HINTED, NAMED, ARTICLE = -0.5, 1.3, 1.3, 4.0, -4.0  # priors as log odds of boilerplate
NEVER = float("inf")
SLOT_PARTS = 2  # outermost elements that make a slot
CLASS_SHARE = 0.25  # of a class's pages from which it reports a run; below ARTICLE_SHARE
SEEN = 1 << 18  # pages that a task remembers in order to send copies once

#: Elements that are not main text by their meaning (a header only outside of articles).
BOILERPLATE = frozenset("nav footer aside menu dialog header".split())
#: Elements without text of the page, and forms.
SKIPPED = frozenset("form script style noscript template iframe svg math button select option textarea head title object audio video canvas map input label datalist".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label acronym".split())
SPACES = frozenset("br td th".split())
_WORD_END = r"(?=$|[\s_-]|list|box|bar|area|section|wrap|container|block)"
#: Words in class, id or role of what differs from page to page, so that no repetition shows it.
UNSEEN = re.compile(
    r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reply|respond|discussion|sidebars?|rail|widgets?|breadcrumbs?|pagination|pager|related|recommended|recommendations|teasers?|complementary|form|login|signup|search|hidden)" + _WORD_END,
    re.I,
)
#: Words in class, id or role that suggest a template's text; repetition decides.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promotion|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|overlay|newsletter|subscribe|subscription"
    r"|side|menus?|nav|navbar|navigation|toolbar|topbar|masthead|header|footer|foot|share|sharing|social|tags?|copyright|legal|disclaimer|skip|contentinfo)" + _WORD_END,
    re.I,
)
ZONES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main)(?:[_-]?(?:content|body|text))?(?=$|\s)", re.I)

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z|(?=<[A-Za-z/!]))""", re.S)
_DIGITS = re.compile(r"[0-9]+")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


class Block(NamedTuple):
    text: str
    prior: float  # log odds of boilerplate as the markup has it; NEVER: no main text at all
    zone: bool  # whether it lies in an article
    slot: str


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    has_zone: bool = False


def _marks(name: str, attributes: str) -> tuple[float | None, bool, str]:
    """The prior that an element sets for its content (None: its parent's), whether it is an article's, and its part of a slot."""
    words, zone, hidden, first = "", name in ("article", "main"), False, ""
    if attributes and not attributes.isspace():
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role"):
                words += " " + value
                if key == "class":
                    first = "." + _DIGITS.sub("", value.split(None, 1)[0]) if value.strip() else ""
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    prior = NEVER if name in SKIPPED or hidden else NAMED if name in BOILERPLATE else None
    if words and name not in ("html", "body", "main") and prior is not NEVER:
        if UNSEEN.search(words):
            prior = NEVER
        else:
            zone = zone or bool(ZONES.search(words))
            if HINTS.search(words) and not (zone and not re.search("sponsor|promo|advert", words, re.I)):
                prior = max(prior or HINTED, HINTED)
    return prior, zone, name + first


def parse(source: str | None) -> Page:
    page = Page()
    if not source:
        return page
    open_: list[tuple[str, float | None, bool, str]] = []  # name, prior, in an article, slot
    held: list[str] = []
    none: tuple[float | None, bool, str] = (None, False, "")
    prior, zone, slot = none

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            page.blocks.append(Block(text, (ARTICLE if zone else NEUTRAL) if prior is None else prior, zone, slot))
            if zone and prior is None:
                page.has_zone = True

    at, end = 0, len(source)
    while at < end:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else end]
        if text:
            held.append(html_lib.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[2] is None:
            continue
        name = m[2].lower()
        inline = name in INLINE
        if name in SPACES:
            held.append(" ")
        elif not inline:
            flush()
        if m[1]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if k and any(x[0] in ("article", "main", "nav", "footer", "aside", "body") for x in open_[k + 1 :]) and name in INLINE | {"p", "li"}:
                        break  # a stray end tag does not close the section around it
                    del open_[k:]
                    outer = open_[-1][1:] if open_ else none
                    if inline and outer[:2] != (prior, zone):
                        flush()
                    prior, zone, slot = outer
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = close.end() if close else end
            continue
        own, inner, label = _marks(name, m[3])
        if name == "header" and zone and own == NAMED:
            own = None
        if inline and (own is not None and own != prior or inner and not zone):
            flush()
        if name == "p" and open_ and open_[-1][0] == "p":  # an open paragraph ends where the next begins
            open_.pop()
            prior, zone, slot = open_[-1][1:] if open_ else none
        if own is not None:
            prior = own if prior is None else max(prior, own)
        zone = zone or inner
        if not inline and name not in ("html", "body") and slot.count("/") < SLOT_PARTS:
            slot += "/" + label
        open_.append((name, prior, zone, slot))
    flush()
    if page.has_zone:
        page.blocks = [b._replace(prior=BESIDE) if b.prior == NEUTRAL else b for b in page.blocks]
    return page


class Runs(NamedTuple):
    """Of each position of the concatenated streams: different pages of a repeated run that covers it, and the length of the longest one (0: none)."""

    pages: np.ndarray
    length: np.ndarray
    starts: np.ndarray  # of the streams


def ranked(tokens: np.ndarray, ends: np.ndarray, run: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of the suffixes (each up to its stream's end) by their first tokens, 1, ... `run` of them; and the suffixes in order of the last ranks, ties by place."""
    n = len(tokens)
    every = np.arange(n)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    levels, width = [(1, rank)], 1
    bits = int(n + 1).bit_length()
    while width < run:  # ranks of longer prefixes, as many of the last ones at once as a number holds
        key, reach = rank, width
        for _ in range(63 // bits - 1):
            if reach < run:
                step = min(reach, run - width)
                nxt = np.zeros(n, np.int64)  # what passes a stream's end is told apart by 0
                nxt[: n - step] = rank[step:]
                nxt[every + step >= ends] = 0
                key, reach = key << bits | nxt, step + width
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        width = reach
        levels.append((width, rank))
    return levels, np.argsort(rank, kind="stable")


def suffix_array(tokens: np.ndarray, ends: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in order (each up to its stream's end, ties by place), the common prefix of each with the next, ranks by `run` tokens and their order.

    Prefixes are the whole ones where `run` tokens agree; suffixes that share less come in order of these tokens only.
    """
    n = len(tokens)
    every = np.arange(n)
    levels, order = ranked(tokens, ends, run)
    width, rank = levels[-1]
    coarse = rank
    first = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, every, 0)) + 1  # a group's rank is its place, so groups can be sorted by themselves
    size = np.diff(np.append(np.flatnonzero(first), n))
    active = order[np.repeat(size, size) > 1]
    active = active[active + run <= ends[active]]
    longest = int((ends - every).max(initial=0))
    while len(active) and width < longest:
        after = active + width
        nxt = np.where(after < ends[active], rank[np.minimum(after, n - 1)], 0)
        o = np.lexsort((nxt, rank[active]))
        active, nxt = active[o], nxt[o]
        group = rank[active]
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        new = new_group | np.concatenate(([True], nxt[1:] != nxt[:-1]))
        place = np.arange(len(active))
        within = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
        rank = rank.copy()
        rank[active] = group + within
        width *= 2
        levels.append((width, rank))
        size = np.diff(np.append(np.flatnonzero(new), len(active)))
        active = active[np.repeat(size, size) > 1]
    suffixes = np.argsort(rank, kind="stable")
    lcp = np.zeros(n, np.int64)
    i, j = suffixes[:-1], suffixes[1:]
    at = np.flatnonzero((coarse[i] == coarse[j]) & (i + run <= ends[i]) & (j + run <= ends[j]))
    i, j = i[at], j[at]
    shared, room = np.zeros(len(at), np.int64), np.minimum(ends[i] - i, ends[j] - j)
    widths = [w for w, _ in levels]
    for k in range(len(levels) - 1, -1, -1):
        w, r = levels[k]
        # What is left is less than the next width.
        for _ in range(1 if w >= run else (widths[k + 1] - 1) // w):
            x, y = np.minimum(i + shared, n - 1), np.minimum(j + shared, n - 1)
            shared = np.where((shared < room) & (r[x] == r[y]), np.minimum(shared + w, room), shared)
    lcp[at] = shared
    return suffixes, lcp, coarse, order


def covered(streams: list[np.ndarray], digests: list[int], run: int = RUN) -> Runs:
    """What the streams' maximal repeated runs of `run` tokens and more cover; streams of equal digest are one page."""
    first: dict[int, int] = {}
    for k, d in enumerate(digests):
        first.setdefault(d, k)
    once = _covered([streams[k] for k in first.values()], run)
    if len(first) == len(streams):
        return once
    at = {d: i for i, d in enumerate(first)}
    parts = [slice(int(once.starts[at[d]]), int(once.starts[at[d] + 1])) for d in digests]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in streams]))).astype(np.int64)
    return Runs(*(np.concatenate([x[p] for p in parts]) for x in (once.pages, once.length)), starts)


def _covered(streams: list[np.ndarray], run: int) -> Runs:
    starts = np.concatenate(([0], np.cumsum([len(s) for s in streams]))).astype(np.int64)
    n = int(starts[-1])
    pages, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n <= run or len(streams) < 2:
        return Runs(pages, length, starts)
    tokens = np.concatenate(streams)
    owner = np.repeat(np.arange(len(streams)), np.diff(starts))
    ends = np.repeat(starts[1:], np.diff(starts))
    suffixes, lcp, coarse, order = suffix_array(tokens, ends, run)
    count = _sharing(coarse, order, owner, ends, run)
    count[count < 2] = 0
    # The longest prefix that a suffix shares with one of another page: least common prefix up to the next owner, on either side.
    o = owner[suffixes]
    segment = np.concatenate(([0], np.cumsum(o[1:] != o[:-1])))
    big = int(lcp.max(initial=0)) + 1
    ahead = np.minimum.accumulate((lcp + segment * big)[::-1])[::-1] - segment * big
    before = np.concatenate(([0], lcp[:-1]))
    behind = np.minimum.accumulate(before + (segment[-1] - segment) * big) - (segment[-1] - segment) * big
    reach = np.zeros(n, np.int64)
    reach[suffixes] = np.maximum(ahead, behind)
    # A maximal run starts where the reach does not just go on from the position before.
    start = np.flatnonzero((reach >= run) & ~np.concatenate(([False], reach[1:] == reach[:-1] - 1)))
    for k in range(run):  # a run of `run` tokens covers its last tokens, too; the widest spread counts
        np.maximum(pages[k:], count[: n - k], out=pages[k:])
    return Runs(pages, _painted(n, start, reach[start]), starts)


def _sharing(coarse: np.ndarray, order: np.ndarray, owner: np.ndarray, ends: np.ndarray, run: int) -> np.ndarray:
    """Of each position: different pages that hold the `run` tokens from there on (0: its stream ends before)."""
    r, o = coarse[order], owner[order]
    new_run = np.concatenate(([True], r[1:] != r[:-1]))
    new_page = new_run | np.concatenate(([True], o[1:] != o[:-1]))
    group = np.cumsum(new_run) - 1
    count = np.zeros(len(order), np.int64)
    count[order] = np.bincount(group, new_page).astype(np.int64)[group]
    count[np.arange(len(order)) + run > ends] = 0
    return count


def usual_in_class(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the runs that stand on CLASS_SHARE of a class's different pages, and on how many of them."""
    size = [len(x) for x in streams]
    if sum(size) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens = np.concatenate(streams)
    ends = np.repeat(np.cumsum(size), size)
    levels, order = ranked(tokens, ends, run)  # the suffix array as far as it matters here
    coarse = levels[-1][1]
    count = _sharing(coarse, order, np.repeat(np.arange(len(streams)), size), ends, run)
    at = np.flatnonzero(count >= max(1, CLASS_SHARE * len(streams)))
    at = at[np.unique(coarse[at], return_index=True)[1]]
    return marks(tokens, run)[at], count[at]


def _painted(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """At each of n positions the largest size of the intervals [start, start + size) that cover it."""
    out = np.zeros(n, np.int64)
    power = np.frexp(size.astype(np.float64))[1] - 1
    for k in range(int(power.max(initial=-1)), -1, -1):  # a value stands for the next 2^k positions; two of them make an interval
        at, here = 1 << (k + 1), 1 << k
        if at < 1 << (int(power.max()) + 1):
            before = out.copy()
            np.maximum(out[here:], before[: n - here], out=out[here:])
        mine = power == k
        np.maximum.at(out, start[mine], size[mine])
        np.maximum.at(out, start[mine] + size[mine] - here, size[mine])
    return out


def _tokens(text: str) -> np.ndarray:
    """A number from 1 to 2^32 - 1 for each word of a text whose words one blank parts, by the word's bytes."""
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blanks = np.flatnonzero(a == 32)
    starts = np.concatenate(([0], blanks + 1))
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    x = (a.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 4095]
    if len(a) > 4096:  # else no word is as long
        x *= (2 * (place >> 12) + 1).astype(np.uint64)
    x[blanks] = 0
    h = np.add.reduceat(x, starts)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(0xFFFFFFFF)).astype(np.int64) + 1


_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def _stream(page: Page) -> np.ndarray:
    """Tokens of all blocks, with a mark (0) at each edge."""
    if not page.blocks:
        return np.zeros(1, np.int64)
    edges = np.cumsum([0] + [b.text.count(" ") + 1 for b in page.blocks])
    return np.insert(_tokens(" ".join([b.text for b in page.blocks])), edges, 0)


def _digest(page: Page) -> int:
    return xxhash.xxh3_64_intdigest("\0".join([b.text for b in page.blocks]).encode("utf-8", "surrogatepass")) >> 1


def marks(s: np.ndarray, run: int = RUN) -> np.ndarray:
    """A 64-bit hash of each `run` tokens."""
    n = max(0, len(s) - run + 1)
    x = (s.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = np.zeros(n, np.uint64)
    for k in range(run):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) + x[k : k + n]
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(27)).view(np.int64)


def _cover(n: int, starts: np.ndarray, run: int) -> np.ndarray:
    """Whether each of n positions lies in one of the runs of `run` tokens from starts on."""
    edges = np.zeros(n + run + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + run, -1)
    return np.cumsum(edges)[:n] > 0


def open_runs(page: Page, dropped: set[tuple[str, float]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Position and mark of each run that touches text which stays unless it repeats; dropped: slots that are boilerplate."""
    s = _stream(page)
    touched, at = np.zeros(len(s), bool), 0
    for b in page.blocks:
        words = b.text.count(" ") + 1
        if b.prior not in (NEVER, NAMED, ARTICLE) and (b.slot, b.prior) not in dropped:
            touched[max(0, at + 2 - run) : at + 1 + words] = True
        at += 1 + words
    where = np.flatnonzero(touched[: max(0, len(s) - run + 1)])
    return where, marks(s, run)[where]


class Doubtful(NamedTuple):
    """The text of a page's slots that neither an article nor the markup alone settles."""

    digest: int  # of the whole page
    tokens: np.ndarray
    slots: list[tuple[str, float, int]]  # slot, prior and words of each block


def doubtful(page: Page, run: int = RUN) -> Doubtful:
    """A block of fewer words than a run is filled up with its digest, so it repeats as a whole only."""
    tokens: list[int] = []
    slots: list[tuple[str, float, int]] = []
    for b in page.blocks:
        if b.prior not in (NEVER, NAMED, ARTICLE):
            words = _tokens(b.text).tolist()
            slots.append((b.slot, b.prior, len(words)))
            tokens += [0, *words]
            if len(words) < run:
                tokens += [zlib.crc32(np.array(words).tobytes()) + 1] * (run - len(words))
    return Doubtful(_digest(page), np.array([*tokens, 0] if tokens else [], np.int64), slots)


def different_pages(pages: list[Doubtful]) -> list[Doubtful]:
    """One of the pages of each digest, whatever their order: copies may have other markup."""
    once: dict[int, tuple] = {}
    for p in pages:
        key = (p.slots, p.tokens.tobytes())
        if p.digest not in once or key < once[p.digest][0]:
            once[p.digest] = key, p
    return [p for _, (_, p) in sorted(once.items())]


def evidence(pages: list[Doubtful], run: int = RUN, repeated: np.ndarray | None = None, host_pages: int = 0) -> dict[tuple[str, float], tuple[int, float, float]]:
    """Of one host's pages by slot and prior: different pages that have it, the sum of their covered shares, the log likelihood ratio of boilerplate.

    Of a class of a host: repeated, marks of runs that its other classes have, too; host_pages, different pages of all classes.
    """
    once = different_pages(pages)
    others = max(len(once), host_pages) - 1
    expected = CHANCE + (1 - 2 * CHANCE) * others / (others + SEEN_AT)
    hit, miss = math.log(expected / CHANCE), math.log((1 - expected) / (1 - CHANCE))
    runs = covered([p.tokens for p in once], [p.digest for p in once], run)
    out: dict[tuple[str, float], tuple[int, float, float]] = {}
    for p, start in zip(once, runs.starts.tolist()):
        repeat = runs.pages[start : start + len(p.tokens)] > 1
        if repeated is not None and len(repeated):
            repeat = repeat | _cover(len(repeat), np.flatnonzero(np.isin(marks(p.tokens, run), repeated)), run)
        repeats = np.concatenate(([0], np.cumsum(repeat))).tolist()
        of: dict[tuple[str, float], list[int]] = {}
        at = 0
        for slot, prior, words in p.slots:
            sums = of.setdefault((slot, prior), [0, 0])
            sums[0] += words
            sums[1] += repeats[at + 1 + words] - repeats[at + 1]
            at += 1 + max(words, run)
        for key, (words, hits) in of.items():
            n, c, llr = out.get(key, (0, 0.0, 0.0))
            share = hits / words
            out[key] = (n + 1, c + share, llr + share * hit + (1 - share) * miss)
    return out


def _stretches(flags: np.ndarray) -> np.ndarray:
    """At each position the length of the stretch of set flags that it lies in (0: not set)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    out, size = np.zeros(len(flags), np.int64), edges[1::2] - edges[::2]
    out[flags] = np.repeat(size, size)
    return out


class Bundle:
    """Pages of one host with what they repeat; whole: all pages that the host has."""

    def __init__(self, sources: list[str | None], run: int = RUN, whole: bool = True):
        self.run, self.whole = run, whole
        self.pages = [parse(s) for s in sources]
        self.digests = [_digest(p) for p in self.pages]
        if whole:
            self.runs = covered([_stream(p) for p in self.pages], self.digests, run)

    def texts(self, dropped: set[tuple[str, float]], known: dict[int, list[tuple[int, int]]] | None = None, host_pages: int = 0, usual_marks: np.ndarray | None = None) -> list[str]:
        """Main texts. dropped: slots that are boilerplate. What a part of a host is told: known, by page digest, starts of runs that the host repeats and on how
        many different pages; host_pages, of how many; usual_marks, of runs that count as boilerplate in articles."""
        different = len(set(self.digests)) if self.whole else host_pages
        usual = max(ARTICLE_PAGES, ARTICLE_SHARE * different)
        texts = []
        for k, (p, digest) in enumerate(zip(self.pages, self.digests)):
            words = [b.text.count(" ") + 1 for b in p.blocks]
            if self.whole:
                pages = self.runs.pages[self.runs.starts[k] : self.runs.starts[k + 1]]
                often = pages >= usual
            else:
                size = sum(words) + len(words) + 1
                pages, often = np.zeros(size, np.int64), np.zeros(size, bool)
                for i, n in (known or {}).get(digest, ()):
                    np.maximum(pages[i : i + self.run], n, out=pages[i : i + self.run])
                if usual_marks is not None and len(usual_marks) and any(b.prior == ARTICLE for b in p.blocks):
                    often = _cover(size, np.flatnonzero(np.isin(marks(_stream(p), self.run), usual_marks)), self.run)
            starts = [1 + x for x in np.cumsum([0] + [1 + n for n in words]).tolist()]
            article = sum(n for b, n in zip(p.blocks, words) if b.prior == ARTICLE)
            often &= 2 * _stretches(often) <= article  # what is the better part of the article stays
            kept = []
            for b, at, n in zip(p.blocks, starts, words):
                if b.prior in (NEVER, NAMED) or (b.slot, b.prior) in dropped:
                    continue
                text = b.text
                if b.prior == ARTICLE:
                    gone = often[at : at + n]
                else:
                    gone = pages[at : at + n] >= (max(2, PROSE_SHARE * different) if n >= PROSE_WORDS else 2)
                if gone.any():
                    if gone.mean() >= COVERED:
                        continue
                    text = " ".join([w for w, g in zip(text.split(" "), gone.tolist()) if not g])
                kept.append(text)
            texts.append("\n\n".join(kept))
        return texts


def is_boilerplate(prior, host, others, pages, share):
    """Verdict on a slot from the markup's prior, log likelihood ratios in the host and elsewhere, pages and summed covered shares. Columns."""
    bound = lambda x, most: F.greatest(F.least(x, F.lit(most)), F.lit(-most))
    odds = prior + bound(host, HOST_BOUND) + bound(others, ALL_BOUND)
    # Where no markup speaks against it, most of the slot's text must repeat: else its covered lines go one by one.
    return (F.round(odds, 9) > 0) & ((prior > 0) | (F.round(share - 0.5 * pages, 6) >= 0))  # rounded: sums depend on their order


def extract_bundle(sources: list[str | None], run: int = RUN) -> list[str]:
    """Main texts of the pages of one host, by its own evidence."""
    bundle = Bundle(sources, run)
    bound = lambda x, most: max(-most, min(most, x))
    found = evidence([d for d in map(doubtful, bundle.pages) if d.slots], run).items()
    return bundle.texts({key for key, (n, c, llr) in found if round(key[1] + bound(llr, HOST_BOUND), 9) > 0 and (key[1] > 0 or round(c - 0.5 * n, 6) >= 0)})


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 64).alias("bytes"))
    large = sizes.filter(F.col("bytes") > bundle_bytes).select("host", F.ceil(F.col("bytes") / bundle_bytes).cast("long").alias("bundles"))
    scratch = Scratch(pages.sparkSession, "extract")
    large = scratch.table(large, "large-hosts")
    spread = F.xxhash64("page_id", F.monotonically_increasing_id())
    dealt = rows.withColumn("spread", spread).join(large, "host", "left").withColumn("bundle", F.pmod("spread", F.coalesce("bundles", F.lit(1))))
    schema = T.StructType([pages.select(F.col(id_col).alias("page_id")).schema[0], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
        for b in (x.slice(i, size) for x in batches for i in range(0, len(x), size)):
            yield b, b["host"].to_pylist()

    def first(seen: set, key: tuple) -> bool:
        """Whether the task meets the page for the first time, as far as it remembers; what reads its rows takes copies once, too."""
        if key in seen:
            return False
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(key)
        return True

    def doubts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b, hosts in sliced(batches, 500):
            rows = []
            for h, source in zip(hosts, b["html"]):
                page = parse(source.as_py())
                d = doubtful(page, run)
                tokens = d.tokens.astype("<u4").tobytes()
                zone = any(x.prior == ARTICLE for x in page.blocks)
                if first(seen, (h, d.digest, zone, xxhash.xxh3_128_digest(tokens + repr(d.slots).encode("utf-8", "surrogatepass")))):
                    rows.append((h, d.digest, zone, tokens, *([x[k] for x in d.slots] for k in range(3))))
            types = (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int32()))
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["host", "digest", "zone", "tokens", "slots", "priors", "words"])

    def read_doubts(t: pa.Table) -> list[Doubtful]:
        lists = [t[c].to_pylist() for c in ("slots", "priors", "words")]
        return [Doubtful(d, np.frombuffer(x, "<u4").astype(np.int64), list(zip(*of))) for d, x, *of in zip(t["digest"].to_pylist(), t["tokens"].to_pylist(), *lists)]

    def tally(key: tuple, t: pa.Table) -> pa.Table:
        """Marks of a class's doubtful text, and whether two of its pages have them."""
        found = [np.unique(marks(p.tokens, run)) for p in different_pages(read_doubts(t))]
        mark, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"host": pa.array([key[0].as_py()] * len(mark), pa.string()), "class": pa.array(np.full(len(mark), key[1].as_py()), pa.int64()), "mark": mark, "alone": n == 1})

    def weigh(key: tuple, t: pa.Table, k: pa.Table) -> pa.Table:
        host_pages = max((x for x in k["host_pages"].to_pylist() if x is not None), default=0)
        found = evidence(read_doubts(t), run, k["mark"].drop_null().to_numpy(), host_pages) if len(t) else {}
        n = len(found)
        cols = [pa.array([key[0].as_py()] * n, pa.string()), pa.array([k for k, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
        cols += [pa.array([v[k] for v in found.values()], pa.float64()) for k in range(3)]
        return pa.Table.from_arrays(cols, names=["host", "slot", "prior", "pages", "share", "llr"])

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b, hosts in sliced(batches, 500):
            rows = []
            for h, n, source in zip(hosts, b["bundles"].to_pylist(), b["html"]):
                page = parse(source.as_py())
                digest = _digest(page)
                if first(seen, (h, digest)):
                    rows.append((h, digest % n, digest, _stream(page).astype("<u4").tobytes()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=["host", "class", "digest", "tokens"])

    def usual(key: tuple, t: pa.Table) -> pa.Table:
        once = dict(zip(t["digest"].to_pylist(), t["tokens"].to_pylist()))
        mark, n = usual_in_class([np.frombuffer(x, "<u4").astype(np.int64) for x in once.values()], run)
        return pa.table({"host": pa.array([key[0].as_py()] * len(mark), pa.string()), "class": pa.array(np.full(len(mark), key[1].as_py()), pa.int64()), "mark": mark, "n": n})

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in sliced(batches, 500):
            row, digest, place, mark = [], [], [], []
            for i, (source, gone) in enumerate(zip(b["html"], b["gone"])):
                page = parse(source.as_py())
                at, found = open_runs(page, {(x["slot"], x["prior"]) for x in gone.as_py() or ()}, run)
                row.append(np.full(len(at), i))
                digest.append(np.full(len(at), _digest(page)))
                place.append(at)
                mark.append(found)
            where, *cols = (pa.array(np.concatenate(x), pa.int64()) for x in (row, digest, place, mark))
            yield pa.RecordBatch.from_arrays([b["host"].take(where), b["bundle"].take(where), *cols], names=["host", "bundle", "digest", "place", "mark"])

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b, hosts in sliced(batches, 100):
            row, digest, mark = [[np.zeros(0, np.int64)] for _ in range(3)]
            for i, (h, source) in enumerate(zip(hosts, b["html"])):
                page = parse(source.as_py())
                d = _digest(page)
                if first(seen, (h, d)):
                    found = np.unique(marks(_stream(page), run))
                    row.append(np.full(len(found), i))
                    digest.append(np.full(len(found), d))
                    mark.append(found)
            where, *cols = (pa.array(np.concatenate(x), pa.int64()) for x in (row, digest, mark))
            yield pa.RecordBatch.from_arrays([b["host"].take(where), *cols], names=["host", "digest", "mark"])

    # Of pages that an article or the markup settles, little more than a digest is sent.
    sent = rows.select("host", "html").mapInArrow(doubts, "host string, digest long, zone boolean, tokens binary, slots array<string>, priors array<double>, words array<int>")
    sent = scratch.table(sent, "doubts").join(large, "host", "left").withColumn("class", F.pmod("digest", F.coalesce("bundles", F.lit(1))))
    several = sent.filter("bundles IS NOT NULL")
    # Different pages of the classes of large hosts, and up to how many of them hold a run that the class does not report.
    classes = several.groupBy("host", "class").agg(F.count_distinct("digest").alias("pages"), F.max("zone").alias("zone"))
    classes = scratch.table(classes.withColumn("unsaid", F.ceil(F.greatest(F.lit(1.0), CLASS_SHARE * F.col("pages"))).cast("long") - 1), "classes")
    hosts = classes.groupBy("host").agg(F.sum("pages").alias("host_pages"), F.sum("unsaid").alias("all_unsaid"), F.max("zone").alias("zone"))

    # Evidence: what other classes repeat is told to those that hold it once.
    doubted = sent.filter("size(slots) > 0")
    apart = scratch.table(doubted.filter("bundles IS NOT NULL").groupBy("host", "class").applyInArrow(tally, "host string, class long, mark long, alone boolean"), "tally")
    shared = apart.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    doubted_pages = doubted.filter("bundles IS NOT NULL").groupBy("host").agg(F.count_distinct("digest").alias("host_pages"))
    hints = apart.filter("alone").drop("alone").join(shared, ["host", "mark"]).select("host", "class", "mark")
    hints = hints.unionByName(classes.select("host", "class").join(doubted_pages, "host"), allowMissingColumns=True)
    slots = doubted.select("host", "class", "digest", "tokens", "slots", "priors", "words").groupBy("host", "class").cogroup(hints.groupBy("host", "class"))
    slots = slots.applyInArrow(weigh, "host string, slot string, prior double, pages double, share double, llr double")
    sums = [F.sum(c).alias(c) for c in ("pages", "share", "llr")]
    per_host = scratch.table(slots.groupBy("host", "slot", "prior").agg(*sums), "slots")
    overall = per_host.groupBy("slot", "prior").agg(F.sum("llr").alias("all_llr"))
    verdicts = per_host.join(overall, ["slot", "prior"]).filter(is_boilerplate(F.col("prior"), F.col("llr"), F.col("all_llr") - F.col("llr"), F.col("pages"), F.col("share")))
    verdicts = scratch.table(verdicts.select("host", "slot", "prior"), "verdicts")

    # In articles: runs that are on enough pages by what the classes report, and runs of which that is open.
    zoned = large.join(hosts.filter("zone").select("host"), "host", "left_semi")
    reported = rows.select("host", "html").join(zoned, "host").select("host", "bundles", "html").mapInArrow(streams, "host string, class long, digest long, tokens binary")
    reported = scratch.table(reported.groupBy("host", "class").applyInArrow(usual, "host string, class long, mark long, n long"), "usual")
    reported = reported.join(classes, ["host", "class"]).groupBy("host", "mark").agg(F.sum("n").alias("n"), F.sum("unsaid").alias("unsaid")).join(hosts, "host")
    needed = F.greatest(F.lit(float(ARTICLE_PAGES)), ARTICLE_SHARE * F.col("host_pages"))
    reported = scratch.table(reported.select("host", "mark", "n", needed.alias("needed"), (F.col("n") + F.col("all_unsaid") - F.col("unsaid")).alias("most")).filter("most >= needed"), "reported")
    unclear = reported.filter("n < needed")

    # Of other text that stays in hosts of several bundles, every run is counted over all text of the host's pages, as within a bundle.
    kinds = several.select("host", F.explode(F.arrays_zip("slots", "priors")).alias("x")).select("host", F.col("x.slots").alias("slot"), F.col("x.priors").alias("prior")).distinct()
    gone = verdicts.groupBy("host").agg(F.collect_list(F.struct("slot", "prior")).alias("gone"))
    asks = scratch.table(kinds.join(verdicts, ["host", "slot", "prior"], "left_anti").select("host").distinct().join(gone, "host", "left"), "asks")
    asked = dealt.join(asks, "host").select("host", "bundle", "html", "gone").mapInArrow(asking, "host string, bundle long, digest long, place long, mark long")
    asked = scratch.table(asked, "asked")
    counted_hosts = asks.select("host").union(unclear.select("host")).distinct()
    everywhere = rows.join(counted_hosts, "host", "left_semi").select("host", "html").mapInArrow(all_, "host string, digest long, mark long")
    counted = asked.select("host", "mark").union(unclear.select("host", "mark")).distinct()
    everywhere = everywhere.join(counted, ["host", "mark"], "left_semi").distinct()
    repeated = scratch.table(everywhere.groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    # A run that all pages of a hot host hold is a hot key of a plain join, whose large partitions Spark splits.
    known = asked.join(repeated, ["host", "mark"]).select("host", "bundle", "digest", "place", "n").distinct()
    often = reported.filter("n >= needed").select("host", "mark").union(unclear.drop("n").join(repeated, ["host", "mark"]).filter("n >= needed").select("host", "mark"))

    def of_bundles(df: DataFrame) -> DataFrame:
        """df, whose rows have a host, for each of the host's bundles."""
        return df.join(large, "host", "left").withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("bundles", F.lit(1).cast("long")) - 1))).drop("bundles")

    # One table of what a bundle is told: slots that go, and in a host of several ones its number of different pages and the runs that it repeats.
    told = known.unionByName(of_bundles(verdicts), allowMissingColumns=True)
    told = told.unionByName(of_bundles(often), allowMissingColumns=True).unionByName(of_bundles(hosts.select("host", "host_pages")), allowMissingColumns=True)

    def bundle(key: tuple, t: pa.Table, k: pa.Table) -> pa.Table:
        texts: list[str] = []
        if len(t):
            by_page: dict[int, list[tuple[int, int]]] = {}
            gone, host_pages, often = set(), 0, []
            for x in k.to_pylist():
                if x["slot"] is not None:
                    gone.add((x["slot"], x["prior"]))
                elif x["digest"] is not None:
                    by_page.setdefault(x["digest"], []).append((x["place"], x["n"]))
                elif x["mark"] is not None:
                    often.append(x["mark"])
                elif x["host_pages"] is not None:
                    host_pages = x["host_pages"]
            texts = Bundle(t["html"].to_pylist(), run, whole=not host_pages).texts(gone, by_page, host_pages, np.array(often, np.int64))
        return pa.table({"page_id": t["page_id"], "url": t["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    grouped = dealt.select("host", "bundle", "page_id", "url", "html").groupBy("host", "bundle")
    return grouped.cogroup(told.groupBy("host", "bundle")).applyInArrow(bundle, schema)
