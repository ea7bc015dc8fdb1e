"""Main text of web pages by consensus host paths.

Each page scores its containers by the text that stands in them outside links, and votes for the
path of the best one: the chain of tags and classes from the root, digits generalised. Spark counts
the votes of each host, one a page; then every page is read again and its text taken from the elements on its
host's winning path, or from its own best container where it has none.

Where no article or main element marks it, the best container grows to the parents that hold more of the article beside it: headings, paragraphs, lists,
tables, quotations, or a quarter of text more. Text in links counts only on pages that have no other.

Left out everywhere: scripts, styles and other raw or control elements, menus, headers, footers,
sidebars, forms, and elements whose class, id or role names an advert, notice, menu, sidebar, share
bar or reader comments. Compound names count by their last part, or by their first if the others only say where or what
kind of box (``ad-slot``, not ``ad-hoc``, ``no-sidebar`` or ``search-result``); capitals within a name and double marks part it too, and
numbers and sizes don't count (``AdBox``, ``ad-300x250``, ``post-comments__list``). A form, or an element
that is named so, but holds more than half of the page's text is kept, unless it is hidden or named for comments, adverts or
consent. Of a header in an article the headings are kept. Blocks are joined by a newline; white space within a block is one space.

Tags are read as browsers do: values without quotes may hold quotes, and a tag, quote or comment that is never closed ends
with the page. Reading is linear in the page. What is nested deeper than ``DEPTH`` counts as part of the element there, but what is left out at any size is left out at any depth.

Defined results: null or empty html gives an empty text; a null url counts as the host ""; unclosed
and stray tags are repaired in the usual way; very long pages are read whole; of paths with as many votes the one with more
text wins, then the last by name; repeated rows vote and
come out once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
SKIPPED = RAW | frozenset("head nav header footer aside button select option fieldset dialog menu object canvas audio video map datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead td th tr caption ul".split())
CONTAINERS = frozenset("html body article main section div td center blockquote figure".split())
#: A start tag that ends open elements of these kinds, up to the nearest element of the second kind.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " sidebar side-bar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer comment comments commentlist respond disqus replies"
    " share sharing social related recommended newsletter subscribe signup login search toolbar skip-link widget complementary contentinfo search-form hidden responses outbrain taboola".split()
)
#: Parts that make a compound name one of the page's layout, and parts that only say where or what kind of box.
LAYOUT = frozenset("no not non has have with without overflow".split())
BOXES = frozenset(
    "area bar block body bottom box buttons col column container content desktop end first footer group head header holder icons inner inline item items label last left"
    " link links list main mobile outer page panel primary right row secondary section site slot space start text thread title top unit widget widgets wrap wrapper zone form posts".split()
)
#: Names that are left out at any size.
ALWAYS = frozenset("comment comments commentlist respond disqus replies hidden ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr responses outbrain taboola".split())
_AFTER = BOXES | NOISE
DEPTH = 512
_HEADER = frozenset(["header"])
_MARKS, _CAPITAL, _DIGITS, _SIZE = (re.compile(x) for x in (r"[-_]+", r"(?<=[a-z0-9])(?=[A-Z])", r"(?<=[a-z])\d+$", r"\d+(?:x\d+)?"))
#: What says that text beside the best container belongs to the article.
PROSE = HEADINGS | frozenset("p li dd dt pre blockquote figcaption td th".split())
_NAME, _GAP, _KEY, _IS, _BARE = (re.compile(x) for x in (r"</?([a-zA-Z][^\s/>]*)", r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))


@dataclass
class Page:
    """labels, parents and path numbers of the elements, and the blocks of text that are not left out: (element, text, characters in links)."""

    labels: list[str] = field(default_factory=lambda: ["html"])
    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    paths: list[int] = field(default_factory=lambda: [0])
    known: dict[tuple[int, str], int] = field(default_factory=lambda: {(-1, "html"): 0})
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def add(self, parent: int, tag: str, label: str) -> int:
        self.labels.append(label)
        self.tags.append(tag)
        self.parents.append(parent)
        self.paths.append(self.known.setdefault((self.paths[parent], label), len(self.known)))
        return len(self.labels) - 1

    def path(self, node: int) -> str:
        found = []
        while node >= 0:
            found.append(self.labels[node])
            node = self.parents[node]
        return "\n".join(reversed(found))

    def number(self, path: str) -> int:
        """The path's number, -1 if no element has it."""
        at = -1
        for k, label in enumerate(path.split("\n")):
            at = self.known.get((at, label), -1)
            if at < 0:
                return -1
        return at


def _parts(name: str) -> list[str]:
    """Words of a name: parted at marks and at capitals after small letters, without numbers and sizes."""
    words = _MARKS.split(_CAPITAL.sub("-", name).lower())
    return [w for w in (_DIGITS.sub("", w) for w in words if not _SIZE.fullmatch(w)) if w]


def _named(name: str, names: frozenset[str]) -> bool:
    parts = _parts(name)
    if not parts:
        return False
    if name.lower() in names or "-".join(parts) in names:
        return True
    if len(parts) == 1 or LAYOUT.intersection(parts):
        return False
    core = len(parts)  # the kind of box at the end doesn't count where comments or adverts are named
    while core > 1 and parts[core - 1] in BOXES:
        core -= 1
    return parts[-1] in names or parts[core - 1] in names and parts[core - 1] in ALWAYS or parts[0] in names and _AFTER.issuperset(parts[1:])


def _noise(attributes: dict[str, str], names: frozenset[str] = NOISE) -> bool:
    if any(_named(part, names) for name in ("class", "id", "role") if name in attributes for part in attributes[name].split()):
        return True
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


def _tag(source: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """Attributes of the tag whose name ends at ``at``, whether it ends in a slash, and where it ends. None if the page ends first."""
    attributes: dict[str, str] = {}
    while True:
        at = _GAP.match(source, at).end()
        if at >= len(source):
            return None
        if source[at] == ">":
            return attributes, source[at - 1] == "/", at + 1
        key = _KEY.match(source, at)
        at, value = key.end(), ""
        if m := _IS.match(source, at):
            at = m.end()
            quote = source[at : at + 1]
            if quote in ('"', "'"):
                end = source.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = source[at + 1 : end], end + 1
            else:
                m = _BARE.match(source, at)
                value, at = m[0], m.end()
        attributes.setdefault(key[0].lower(), value)


def _marks(source: str) -> Iterator[tuple[int, int, str, bool, dict[str, str], bool]]:
    """Each tag: where it starts and ends, name, whether it closes, attributes, whether it ends in a slash. Comments have no name. Jumps may be sent in."""
    at = 0
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = at + 4 if source.startswith(">", at + 4) else at + 5 if source.startswith("->", at + 4) else source.find("-->", at + 4) + 2
            end = len(source) if end == 1 else end + 1
            yield at, end, "", False, {}, False
            at = end
        elif m := _NAME.match(source, at):
            found = _tag(source, m.end())
            if found is None:
                yield at, len(source), "", False, {}, False
                return
            jump = yield at, found[2], m[1].lower(), source[at + 1] == "/", found[0], found[1]
            at = jump or found[2]
        elif source[at + 1 : at + 2] in ("!", "?", "/"):
            end = source.find(">", at)
            end = len(source) if end < 0 else end + 1
            yield at, end, "", False, {}, False
            at = end
        else:  # a sign, not a tag
            at += 1


def _next(marks: Iterator, jump: int | None) -> tuple | None:
    try:
        return marks.send(jump)
    except StopIteration:
        return None


def parse(source: str, spared: frozenset[int] = frozenset()) -> Page:
    """The page, with the elements that start at ``spared`` whatever their names."""
    page, links, flat = Page(), 0, Counter()
    saved: list[tuple[int, Counter]] = []  # by the depth of an element that is left out: the elements beyond DEPTH around it
    # tag, element, left out, depth of the nearest block, raw and control elements around, articles around, whether it is an article's header
    stack: list[tuple[str, int, bool, int, int, int, bool]] = [("html", 0, False, 0, 0, 0, False)]
    opened: Counter = Counter()
    doubt: list[tuple[int, int, int]] = []  # depth and start of elements left out by name only, and what had been dropped there
    sizes: Counter = Counter()  # the text in each
    dropped = 0
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined and not stack[-1][2]:
                page.blocks.append((stack[-1][1], joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, flat
        while saved and saved[-1][0] >= depth:
            flat = saved.pop()[1]
        for tag, *_ in stack[depth:]:
            links -= tag == "a"
            opened[tag] -= 1
        while doubt and doubt[-1][0] >= depth:
            _, start, before = doubt.pop()
            if start >= 0:
                sizes[start] += dropped - before
        del stack[depth:]

    def said(lo: int, hi: int) -> None:
        nonlocal linked, dropped
        if hi <= lo:
            return
        if not stack[-1][2]:
            piece = source[lo:hi]
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            linked += len(piece) if links else 0
        elif doubt and not links and doubt[-1][1] >= 0 and stack[-1][4] == stack[doubt[0][0] - 1][4]:
            dropped += len(" ".join(source[lo:hi].split()))

    marks, at = _marks(source), 0
    mark = next(marks, None)
    while mark is not None:
        start, end, tag, closes, attributes, slash = mark
        said(at, start)
        at, jump = end, None
        if not tag:
            pass
        elif closes:
            if flat[tag]:
                flat[tag] -= 1
            elif opened[tag]:
                depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                if stack[-1][3] >= depth:
                    flush()
                close(depth)
        elif tag in ("html", "body") and opened[tag]:
            pass
        elif tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            after = source.find(">", m.end()) if m else -1
            at = jump = after + 1 if after >= 0 else len(source)
        else:
            if tag in BLOCKS:
                flush()
                if tag in ENDS:
                    kinds, within = ENDS[tag]
                    if any(opened[k] for k in kinds):
                        for k in range(len(stack) - 1, 0, -1):
                            if stack[k][0] in within:
                                break
                            if stack[k][0] in kinds:
                                close(k)
                                break
                elif stack[depth := stack[-1][3]][0] == "p" and depth:  # a block ends an open paragraph, and what stands open in it
                    close(depth)
            if tag in VOID:
                if tag == "br":
                    text.append(" ")
            elif not (slash and tag not in BLOCKS):
                _, node, out, block, around, articles, header = stack[-1]
                deep = len(stack) >= DEPTH
                if deep and (out or not (tag in SKIPPED or attributes and _noise(attributes, ALWAYS))):
                    flat[tag] += 1
                else:
                    if deep:  # left out at any depth; what is open in it is counted apart
                        saved.append((len(stack), flat))
                        flat = Counter()
                    named = start not in spared and tag not in ("html", "body") and (tag == "form" or bool(attributes) and _noise(attributes))
                    # an article's header is left out but for its headings
                    heads = articles > 0 and (tag == "header" or named and tag in CONTAINERS and _noise(attributes, _HEADER) and not _noise(attributes, NOISE - _HEADER))
                    tagged = tag in SKIPPED and not heads
                    left_out = out and not (header and tag in HEADINGS) or tagged or named or heads
                    if tag in BLOCKS:
                        names = sorted({re.sub(r"\d+", "#", w) for w in attributes.get("class", "").lower().split()})
                        node = page.add(node, tag, ".".join([tag, *names]))
                    links += tag == "a"
                    if named and (tag in CONTAINERS or tag == "form") and (doubt or not out) and not _noise(attributes, ALWAYS):
                        doubt.append((len(stack), start, dropped))
                    elif named and doubt:
                        doubt.append((len(stack), -1, dropped))
                    opened[tag] += 1
                    stack.append((tag, node, left_out, len(stack) if tag in BLOCKS else block, around + tagged, articles + (tag in ("article", "main")), heads))
        mark = _next(marks, jump)
    said(at, len(source))
    flush()
    close(1)
    most = sum(len(t) - n for _, t, n in page.blocks)
    if large := [start for start, n in sizes.items() if 2 * n > most + dropped]:
        return parse(source, spared | {*large})
    return page


def best(page: Page) -> tuple[str, float]:
    """Path and score of the container with the most text outside links. An article or main element around it stands for it, or else a parent with more."""
    scores: Counter = Counter()
    whole, prose = [0] * len(page.labels), [0] * len(page.labels)
    alone = all(linked >= len(text) for _, text, linked in page.blocks)
    for node, text, linked in page.blocks:
        worth = len(text) - (0 if alone else linked)
        whole[node] += worth
        prose[node] += worth if page.tags[node] in PROSE else 0
        while node >= 0 and page.tags[node] not in CONTAINERS:
            node = page.parents[node]
        while node >= 0 and worth >= 1:
            scores[node] += worth
            worth /= 2
            node = page.parents[node]
    if not scores:
        return "", 0.0
    for node in range(len(whole) - 1, 0, -1):
        whole[page.parents[node]] += whole[node]
        prose[page.parents[node]] += prose[node]
    top = max(scores, key=lambda n: (scores[n], -n))
    score, node, marked = scores[top], top, False
    while node >= 0:
        if page.tags[node] in ("article", "main"):
            top, marked = node, True
        node = page.parents[node]
    if not marked:  # the parent of several children with text: one that adds prose or a quarter to the best of them
        node = page.parents[top]
        while node >= 0:
            if page.tags[node] in CONTAINERS and (4 * whole[node] >= 5 * whole[top] or prose[node] > prose[top]):
                top = node
            node = page.parents[node]
    return page.path(top), float(score)


def taken(page: Page, path: str | None) -> str:
    """The blocks under the elements on ``path``, in page order; of the page's own best container if there is no such element."""
    for goal in (path, None):
        number = page.number(goal or best(page)[0] or "-") if page.blocks else -1
        if number < 0:
            continue
        under = [False] * len(page.labels)
        for node, parent in enumerate(page.parents):  # parents come before their children
            under[node] = page.paths[node] == number or parent >= 0 and under[parent]
        if found := [t for n, t, _ in page.blocks if under[n]]:
            return "\n".join(found)
    return ""


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars. The table of winners has a row for each host; Spark sends it round only if its size allows."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes, sums = Counter(), Counter()
            for h, source in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                path, score = best(parse(source.as_py() or ""))
                if path:
                    votes[h, path] += 1
                    sums[h, path] += round(score)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(votes.values(), pa.int64()), pa.array([sums[k] for k in votes], pa.int64())], names=["host", "path", "votes", "score"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [taken(parse(source.as_py() or ""), p) for source, p in zip(b.column("html"), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    all_pages = pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("html"), host(F.col(f"`{url}`")).alias("host"))
    votes = all_pages.select("host", "html").mapInArrow(vote, "host string, path string, votes long, score long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    winners = written(votes.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).alias("w")).select("host", F.col("w.path").alias("path")), "winners")
    kind = pages.schema[key].dataType.simpleString()
    return all_pages.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
