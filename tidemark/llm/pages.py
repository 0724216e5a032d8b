"""HTML main-text extraction by a linear-chain conditional random field over leaf blocks (operator 10).

A page is cut into leaf blocks: runs of text between the boundaries of block elements and line
breaks.  A block's features are its ancestors' tags and the words of their class, id and role, and
simple measures of its text.  The field has two labels, main text and other; it is trained in numpy
by stochastic gradient steps on the likelihood (forward-backward) over labelled pages, which
`labelled_pages` composes from layouts with known labels, and pages are decoded by Viterbi in a map.

Text of scripts, styles, templates, comments in markup, head and form controls is never a block.
Character references are decoded, white space in a block becomes one space, and the blocks labelled
main are joined in page order by one newline.  Markup is read in one pass, and neither the depth of a page nor
unended tags make the work grow faster than the page.

Defined results: a null or empty html, or one without text, gives an empty string.  Each input row
gives one row.
"""

from __future__ import annotations

import functools
import html as htmllib
import math
import random
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import map_batches

FEATURE_BITS = 14
TAG_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Elements whose content isn't text of the page.
SILENT = frozenset("script style noscript template svg math iframe object head textarea select option button canvas audio video map".split())
RAW = frozenset("script style textarea noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Opening one of these closes an open element of the same group (up to the nearest container).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SPACE = re.compile(r"[\s\x00]+")


def _path_of(tag: str, attributes: str) -> tuple[str, ...]:
    """An element's features for the blocks below it."""
    out = [tag]
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name in ("hidden", "aria-hidden") and value.lower() != "false":
                out.append("hidden")
            else:
                out += [f"={w}" for w in re.split(r"[^a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", value).lower()) if len(w) > 1 or w == "ad"]
    return tuple(out)


class _Marks:
    """The markup of a page, found in one pass.

    A tag ends at the first > outside quotes; one that never ends is text.  Places from which no end is found are
    remembered, so that a page full of unended tags or quotes is read a few times at most.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()
        self.stop = (0, -1)  # from the first place to the second there is no other stop

    def _end(self, at: int) -> int:
        """Where the tag whose attributes begin at `at` ends; -1 if it doesn't."""
        page, walked, first = self.page, [], True
        while at not in self.dead and at <= max(self.last.values()):
            walked.append(at)
            if first and self.stop[0] <= at <= self.stop[1]:
                stop = self.stop[1]
            else:
                m = TAG_STOP.search(page, at)
                if m is None:
                    break
                stop = m.start()
                if first:
                    self.stop = (at, stop)
            first = False
            if page[stop] == ">":
                return stop + 1
            if stop in self.dead or stop >= self.last[page[stop]]:
                walked.append(stop)
                break
            at = page.find(page[stop], stop + 1) + 1
        self.dead.update(walked)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, str | None, str]]:
        """(start, end, '/' of an end tag, name or None, attributes or CDATA text) of each mark; `skip` moves on."""
        page, at = self.page, 0
        while (start := page.find("<", max(at, self.skip))) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = len(page) if end < 0 else end + 3
                yield start, at, "", None, ""
            elif page.startswith("<![CDATA[", start):
                end = page.find("]]>", start + 9)
                at = len(page) if end < 0 else end + 3
                yield start, at, "", None, page[start + 9 : len(page) if end < 0 else end]
            elif page.startswith(("<!", "<?"), start):
                if start < self.last[">"]:
                    at = page.find(">", start) + 1
                    yield start, at, "", None, ""
            elif m := TAG_NAME.match(page, at):
                end = self._end(m.end())
                if end >= 0:
                    at = end
                    yield start, at, m[1], m[2].lower(), page[m.end() : end - 1]

    skip = 0


class _Open:
    """The open elements, with what is asked of them kept up to date, so that no question walks over them."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that aren't inline
        self.paths: list[tuple | None] = [None]  # the path below each element: (path above it, its features, depth)
        self.silent = 0

    def push(self, tag: str, features: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        path = self.paths[-1]
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
            if tag not in ("html", "body"):
                path = (path, features, (path[2] if path else 0) + 1)
        self.paths.append(path)
        self.tags.append(tag)
        self.silent += tag in SILENT

    def pop_to(self, k: int) -> None:
        while len(self.tags) > k:
            tag = self.tags.pop()
            self.places[tag].pop()
            self.paths.pop()
            if tag not in INLINE:
                self.blocks.pop()
            self.silent -= tag in SILENT

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of one of the tags; -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def leaf_blocks(page: str) -> list[tuple[tuple | None, str, float]]:
    """(path, text, share of text in links) of a page's leaf blocks; a path is (path above, features, depth) of the innermost element, None at the top."""
    blocks: list[tuple[tuple | None, str, float]] = []
    open_, marks = _Open(), _Marks(page)
    text: list[str] = []
    linked, done = 0, 0
    path: tuple | None = None
    begun = False

    def flush() -> None:
        nonlocal linked, path, begun
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = htmllib.unescape(joined)
            joined = SPACE.sub(" ", joined).strip()
            if joined:
                blocks.append((path, joined, min(1.0, linked / len(joined))))
            text.clear()
        linked, path, begun = 0, None, False

    def add(piece: str) -> None:
        nonlocal linked, path, begun
        if piece and not open_.silent:
            if not begun and not piece.isspace():
                path, begun = open_.paths[-1], True
            text.append(piece)
            linked += len(piece) if open_.places.get("a") else 0

    for start, end, closing, tag, rest in marks:
        add(page[done:start])
        done = end
        if tag is None:
            add(rest)
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if open_.places.get(tag):
                open_.pop_to(open_.places[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and open_.blocks and open_.tags[open_.blocks[-1]] == "p":  # a block element ends an open paragraph
            open_.pop_to(open_.blocks[-1])
        if tag == "body" and open_.places.get("head"):  # a head that wasn't closed
            open_.pop_to(open_.places["head"][0])
        if tag in CLOSES:
            own, stop = CLOSES[tag]
            if open_.last(own) > open_.last(stop):
                open_.pop_to(open_.last(own))
        if rest.endswith("/") and tag in SILENT:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, end)
            done = marks.skip = close.end() if close else len(page)
            continue
        open_.push(tag, _path_of(tag, rest))
    add(page[done:])
    flush()
    return blocks


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << FEATURE_BITS) - 1)


@functools.lru_cache(20_000)
def _element_slots(features: tuple[str, ...], kind: str) -> tuple[int, ...]:
    return tuple(sorted({_slot(f"{kind}:{x}") for x in features}))


def _path_features(path: tuple | None) -> np.ndarray:
    """The slots of a block's ancestors, and of its innermost one once more."""
    slots = set(_element_slots(path[1], "top")) if path else set()
    while path:
        slots.update(_element_slots(path[1], "anc"))
        path = path[0]
    return np.array(sorted(slots), np.int64)


class _PathWeights:
    """The weights of the paths of one page's blocks, in page order: only what opens and closes in between is added and taken away."""

    def __init__(self, emit: list[list[float]]):
        self.emit, self.held, self.count, self.sums = emit, [], {}, [0.0, 0.0]

    def _move(self, path: tuple, step: int) -> None:
        for slot in _element_slots(path[1], "anc"):
            before = self.count.get(slot, 0)
            self.count[slot] = before + step
            if before + step == (1 if step > 0 else 0):
                for k in (0, 1):
                    self.sums[k] += step * self.emit[slot][k]
        if not self.held:
            self.sums = [0.0, 0.0]

    def of(self, path: tuple | None) -> tuple[float, float]:
        fresh, target = [], path
        while target and (len(self.held) < target[2] or self.held[target[2] - 1] is not target):
            fresh.append(target)
            target = target[0]
        while len(self.held) > (target[2] if target else 0):
            self._move(self.held.pop(), -1)
        for p in reversed(fresh):
            self.held.append(p)
            self._move(p, 1)
        x, y = self.sums
        for slot in _element_slots(path[1], "top") if path else ():
            if not self.count.get(slot):
                x += self.emit[slot][0]
                y += self.emit[slot][1]
        return x, y


_TEXT_NAMES = [f"len:{k}" for k in range(8)] + [f"link:{k}" for k in range(3)] + ["stop", "copyright", "always"]
_TEXT_SLOTS = {name: _slot(f"text:{name}") for name in _TEXT_NAMES}


def _text_features(text: str, linked: float) -> list[int]:
    s = _TEXT_SLOTS
    out = [s["always"], s[f"len:{min(7, int(math.log2(len(text))) if text else 0)}"], s[f"link:{0 if linked < 0.2 else 1 if linked < 0.8 else 2}"]]
    if text[-1] in ".!?…。":
        out.append(s["stop"])
    if "©" in text:
        out.append(s["copyright"])
    return out


class ChainField:
    """The conditional random field: weights of features by label, and of label pairs."""

    def __init__(self) -> None:
        self.emit, self.move = np.zeros((1 << FEATURE_BITS, 2)), np.zeros((2, 2))
        self.start = np.zeros(2)  # not trained: how a page begins says little about other layouts

    def features(self, blocks: list[tuple[tuple | None, str, float]]) -> list[np.ndarray]:
        return [np.concatenate([_path_features(p), _text_features(t, share)]) for p, t, share in blocks]

    def fit(self, pages: list[tuple[list, list[int]]], rounds: int = 12, rate: float = 0.4, decay: float = 1e-3, seed: int = 5) -> ChainField:
        rows = [(self.features(blocks), np.array(labels)) for blocks, labels in pages if blocks]
        rnd = random.Random(seed)
        for step in range(rounds):
            rnd.shuffle(rows)
            eta = rate / (1 + step)
            for feats, labels in rows:
                n = len(feats)
                score = np.array([self.emit[f].sum(0) for f in feats])
                forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = self.start + score[0]
                for k in range(1, n):
                    forward[k] = score[k] + np.logaddexp(*(forward[k - 1][:, None] + self.move))
                for k in range(n - 2, -1, -1):
                    backward[k] = np.logaddexp(*(self.move + score[k + 1] + backward[k + 1]).T)
                total = np.logaddexp(*forward[-1])
                wrong = np.eye(2)[labels] - np.exp(forward + backward - total)
                for f, w in zip(feats, wrong):
                    self.emit[f] += eta * (w - decay * self.emit[f])
                for k in range(1, n):
                    pair = np.exp(forward[k - 1][:, None] + self.move + (score[k] + backward[k])[None, :] - total)
                    pair[labels[k - 1], labels[k]] -= 1
                    self.move -= eta * pair / n
        return self

    def ready(self) -> ChainField:
        self.text_weights = {slot: tuple(self.emit[slot]) for slot in _TEXT_SLOTS.values()}
        self.rows = self.emit.tolist()
        return self

    def decode(self, blocks: list[tuple[tuple | None, str, float]]) -> list[int]:
        """The most probable labels, by Viterbi."""
        back: list[tuple[int, int]] = []
        (m00, m01), (m10, m11) = self.move.tolist()
        a = b = 0.0
        weights = _PathWeights(self.rows)
        for k, (path, text, share) in enumerate(blocks):
            x, y = weights.of(path)
            for slot in _text_features(text, share):
                u, v = self.text_weights[slot]
                x += u
                y += v
            if k == 0:
                a, b = self.start[0] + x, self.start[1] + y
                continue
            from0, from1 = a + m01 > b + m11, a + m00 >= b + m10
            back.append((0 if from1 else 1, 0 if from0 else 1))
            a, b = x + max(a + m00, b + m10), y + max(a + m01, b + m11)
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1] if blocks else []


#: Class or id words of the parts that labelled pages are made of.
MAIN_NAMES = "article content main post-body entry-content story article-body post text".split()
OTHER_PARTS = {
    "nav": "nav navbar menu breadcrumb topbar".split(),
    "header": "header site-header masthead banner".split(),
    "footer": "footer site-footer copyright bottom".split(),
    "aside": "sidebar aside related widget recommended".split(),
    "ad": "ad ads advert advertisement sponsored promo".split(),
    "notice": "cookie consent notice gdpr newsletter subscribe popup".split(),
    "comments": "comments comment comment-list reader-comments discussion replies".split(),
    "form": "form search login signup".split(),
    "share": "share social tags meta".split(),
}


def labelled_pages(n: int = 240, seed: int = 17) -> list[tuple[list, list[int]]]:
    """Pages with known labels, as (blocks, labels): main text carries a mark that is taken out again."""
    rnd = random.Random(seed)
    mark = "⁣"

    def words(a: int, b: int) -> str:
        out = " ".join("".join(rnd.choice("abcdefghilmnoprstuvéäñ") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(a, b)))
        return (out[:1].upper() + out[1:] + rnd.choice([".", ".", ".", "", "?", ":", ","])) if out else "A"

    def named(tag: str, name: str, inner: str) -> str:
        how = rnd.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {name}-{rnd.choice(["box", "wrap", "inner"])}"'])
        return f"<{tag}{how}>{inner}</{tag}>"

    def other(kind: str) -> str:
        name = rnd.choice(OTHER_PARTS[kind])
        long = lambda: f"<p>{words(4, 40)}</p>" if rnd.random() < 0.7 else words(3, 30)
        if kind == "nav":
            items = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rnd.randrange(2, 8)))
            return rnd.choice([f"<nav><ul>{items}</ul></nav>", named("div", name, f"<ul>{items}</ul>"), named("ul", name, items)])
        if kind in ("header", "footer"):
            inner = rnd.choice([words(1, 6), f"<p>{words(2, 14)}</p>", f"&copy; 2020 {words(2, 8)}<p>{words(2, 10)}</p>"])
            return rnd.choice([f"<{kind}>{inner}</{kind}>", named("div", name, inner)])
        if kind == "aside":
            return rnd.choice([f"<aside><h3>{words(1, 4)}</h3>{long()}</aside>", named("div", name, f"<h3>{words(1, 4)}</h3>" + long()), named("aside", name, long())])
        if kind == "comments":
            each = "".join(rnd.choice([named("div", "comment", long()), f"<li>{long()}</li>", named("article", "comment", long())]) for _ in range(rnd.randrange(1, 5)))
            return named(rnd.choice(["section", "div", "ol"]), name, f"<h2>{words(1, 3)}</h2>" + each)
        if kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q><button>{words(1, 2)}</button><p>{words(2, 10)}</p>"
            return rnd.choice([f"<form>{inner}</form>", named("form", name, inner)])
        return named(rnd.choice(["div", "section", "div", "p"]), name, rnd.choice([words(2, 30), long(), f'<a href="/y">{words(1, 6)}</a> {words(1, 12)}']).replace("<p>", "<span>").replace("</p>", "</span>"))

    def paragraph() -> str:
        inner = mark + words(1, 3) if rnd.random() < 0.15 else mark + words(3, 70)
        return rnd.choice([f"<p>{inner}</p>"] * 5 + [f"<p><b>{inner}<br><p>{mark}{words(3, 20)}</p>", f"<blockquote>{inner}</blockquote>", f"<ul><li>{inner}</li><li>{mark}{words(1, 9)}</li></ul>", f"<h2>{mark}{words(1, 6)}</h2>", f"<pre>{inner}</pre>", f"<table><tr><td>{inner}</td></tr></table>"])

    pages = []
    for _ in range(n):
        top = [other(k) for k in rnd.sample(["nav", "header", "notice", "ad", "form", "share"], rnd.randrange(1, 4))]
        end = [other(k) for k in rnd.sample(["footer", "comments", "aside", "ad", "share", "form", "notice"], rnd.randrange(1, 4))]
        parts = [f"<h1>{mark}{words(2, 9)}</h1>"] * (rnd.random() < 0.8) + [paragraph() for _ in range(rnd.randrange(1, 16))]
        for kind in rnd.sample(["ad", "share", "comments", "notice", "aside", "form"], rnd.randrange(0, 3)):
            parts.insert(rnd.randrange(1, len(parts) + 1), other(kind))
        body = "".join(parts)
        name = rnd.choice(MAIN_NAMES)
        if rnd.random() < 0.2:  # a page of its own text alone
            top = end = []
        body = rnd.choice([body, f"<div>{body}</div>"]) if rnd.random() < 0.12 else rnd.choice([f"<article>{body}</article>", f"<article>{body}</article>", named("article", name, body), f"<main>{body}</main>", named("div", name, body), f"<main>{named('div', name, body)}</main>"])
        if rnd.random() < 0.3:
            body = named("div", rnd.choice(["page", "wrapper", "container", "site"]), "".join(top) + body + "".join(end))
            top = end = []
        blocks = leaf_blocks("<html><head><title>x</title></head><body>" + "".join(top) + body + "".join(end) + "</body></html>")
        labels = [int(mark in t) for _, t, _ in blocks]
        pages.append(([(p, t.replace(mark, "").strip() or "x", s) for p, t, s in blocks], labels))
    return pages


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns `keep` and `text`, the main text of every page."""
    field = pages.sparkSession.sparkContext.broadcast(ChainField().fit(labelled_pages()))
    source = pages.select(*keep, F.col(html_col).alias("__html"))
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field.value.ready()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = []
                for page in part.column(n_keep).to_pylist():
                    blocks = leaf_blocks(page or "")
                    texts.append("\n".join(t for (_, t, _), main in zip(blocks, model.decode(blocks)) if main))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(n_keep)), pa.array(texts, pa.string())], [*keep, "__main"])

    found = map_batches(source, run, T.StructType([*source.schema.fields[:n_keep], T.StructField("__main", T.StringType())]))
    return found.select(*keep, F.col("__main").alias("text"))


def report(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, the main text and its code points."""
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
