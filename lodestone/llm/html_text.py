"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is parsed leniently into leaf blocks: stretches of text that no block-level tag parts. Each block has
features of its ancestors (tags, words of class, id and role) and of its text (length, share of links,
punctuation, signs). The field has two labels and is trained by stochastic gradients on labelled pages that
`labelled_pages` makes; a page is decoded by Viterbi, and its main blocks are its text.

Defined results: a null or empty html, or a page without main text, gives an empty text; character references are
decoded, white space within a block (line breaks too) becomes one space, blocks are joined by one line feed;
head, scripts, styles and other elements that show no text have no blocks; unclosed tags end where HTML implies
it or with the page; every row is read by itself, repeated or not; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_OPENS = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)|<[!?/]")
#: Attributes up to the end of a tag, where ">" within quotes is none.
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_MARKS = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
# Fixed values of HTML: elements whose content is no markup or is not shown, elements without an end tag, elements that part blocks.
_HIDDEN = frozenset("head title script style noscript template iframe object svg math textarea select canvas audio video datalist".split())
_RAW = frozenset("script style textarea title iframe noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: What a start tag closes if it is open, and the elements that such a search does not leave.
_CLOSES = {t: ("p",) for t in _BLOCK - {"body", "html", "head", "button", "label", "option"}} | {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_SCOPE = frozenset("html body table ul ol dl div article section main td th form button aside nav header footer blockquote".split())
#: What may stand in a head; any other start tag ends it, and so does text.
_IN_HEAD = frozenset("html head title meta link base basefont bgsound script style noscript noframes template".split())
_LENGTHS = (1, 2, 4, 8, 15, 30, 60)


class Frame:
    """An open element: its tag, and what it adds to the features that those above it give to blocks."""

    __slots__ = ("above", "fresh", "hidden", "key", "link", "tag")

    def __init__(self, tag: str, key: tuple, above: Frame | None, active: set[str]):
        self.tag, self.key, self.above = tag, key, above
        own = [f"anc={tag}", *[f"cls={w}" for w in key[1]]]
        self.fresh = tuple(dict.fromkeys(f for f in own if f not in active))
        self.hidden = tag in _HIDDEN or bool(above and above.hidden)
        self.link = tag == "a" or bool(above and above.link)

    @property
    def features(self) -> list[str]:
        found, at = [], self
        while at is not None:
            found.append(at.fresh)
            at = at.above
        return [f for fresh in reversed(found) for f in fresh]


class Stack:
    """The open elements, with the places of each tag among them: no search goes through elements that it doesn't close."""

    def __init__(self):
        self.frames: list[Frame] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.blocks: list[int] = []
        self.active: set[str] = set()
        self.push(Frame("root", ("root", ()), None, self.active))

    @property
    def top(self) -> Frame:
        return self.frames[-1]

    def push(self, frame: Frame) -> None:
        at = len(self.frames)
        self.frames.append(frame)
        self.places.setdefault(frame.tag, []).append(at)
        if frame.tag in _SCOPE:
            self.scopes.append(at)
        if frame.tag in _BLOCK:
            self.blocks.append(at)
        self.active.update(frame.fresh)

    def cut(self, to: int) -> None:
        """Close all from a place on."""
        while len(self.frames) > to:
            frame = self.frames.pop()
            self.places[frame.tag].pop()
            for kept in (self.scopes, self.blocks):
                if kept and kept[-1] == len(self.frames):
                    kept.pop()
            self.active.difference_update(frame.fresh)

    def close(self, tag: str, through_scopes: bool) -> None:
        """Close the innermost open `tag`, unless there is none or a scope stands before it."""
        at = (self.places.get(tag) or [0])[-1]
        if at and (through_scopes or not self.scopes or self.scopes[-1] <= at):
            self.cut(at)

    def near(self) -> str:
        """The tag of the innermost block element."""
        return self.frames[self.blocks[-1]].tag if self.blocks else "root"


def _ends(page: str) -> tuple[list[int], list[int]]:
    """Places of quotes and ">", and for each the first ">" outside of quotes from there on (-1: none), in one pass from the end."""
    marks = [(m.start(), m[0]) for m in _MARKS.finditer(page)]
    out, later = [-1] * (len(marks) + 1), {}
    for i in range(len(marks) - 1, -1, -1):
        at, mark = marks[i]
        if mark == ">":
            out[i] = at
        else:
            if mark in later:
                out[i] = out[later[mark] + 1]
            later[mark] = i
    return [at for at, _ in marks], out


class Tags:
    """The tags and comments of a page in order: (start, end, closing, name, attributes); name is empty for what is no element."""

    def __init__(self, page: str):
        self.page, self.last, self.known = page, page.rfind(">"), None

    def at(self, pos: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while True:
            # After the last ">" only a comment can begin, which the end of the page ends.
            m = _OPENS.search(page, pos) if pos <= self.last else None
            start = m.start() if m else page.find("<!--", pos)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            pos = m.end()
            if pos > self.last:
                continue
            end = self._end(pos) if m[2] else -1
            if end < 0:
                end = page.find(">", pos)
            return start, end + 1, bool(m[1]), m[2] or "", page[pos:end] if m[2] else ""

    def _end(self, pos: int) -> int:
        """The ">" that ends a tag whose name ends at `pos`, or -1."""
        if self.known is None:
            m = _REST.match(self.page, pos)
            if m:
                return m.end() - 1
            self.known = _ends(self.page)  # an odd page: from now on by a table, as each failure would read to its end
        places, out = self.known
        return out[bisect_left(places, pos)]


def _raw_end(page: str, tag: str, pos: int) -> tuple[int, int]:
    """Where the content of an element without markup ends, and where its end tag does."""
    m = re.compile(rf"</{tag}\b", re.IGNORECASE).search(page, pos)
    end = page.find(">", m.end()) if m else -1
    return (m.start(), end + 1) if end >= 0 else (len(page), len(page))


def blocks(page: str) -> list[tuple[str, Frame, str, float]]:
    """(text, frame of the innermost element, tag of the nearest block element, share of link characters) of each leaf block."""
    found: list[tuple[str, Frame, str, float]] = []
    stack, made, tags = Stack(), {}, Tags(page)
    parts: list[str] = []
    linked = size = 0
    first, block, pos, n = stack.top, "root", 0, len(page)

    def flush() -> None:
        nonlocal linked, size
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((text, first, block, linked / max(1, size)))
            parts.clear()
        linked = size = 0

    def leave_head() -> None:
        while stack.top.tag == "head":
            stack.cut(len(stack.frames) - 1)

    def shown(text: str) -> None:
        nonlocal linked, size, first, block
        if stack.top.tag == "head" and html.unescape(text).strip(" \t\n\r\f"):
            leave_head()
        top = stack.top
        if not text or top.hidden:
            return
        if "&" in text:
            text = html.unescape(text)
        if not size and not text.isspace():
            first, block = top, stack.near()
        parts.append(text)
        k = len(text.strip())
        size += k
        if top.link:
            linked += k

    while pos < n:
        found_tag = tags.at(pos)
        if found_tag is None:
            shown(page[pos:])
            break
        start, end, closing, name, attributes = found_tag
        shown(page[pos:start])
        pos = end
        if not name:
            continue
        tag = name.lower()
        if closing:
            if tag in _BLOCK:
                flush()
            stack.close(tag, tag in _BLOCK)
            continue
        if tag not in _IN_HEAD:
            leave_head()
        if tag in _BLOCK:
            flush()
            for closed in _CLOSES.get(tag, ()):
                stack.close(closed, False)
        if tag == "body":  # a head that was never closed ends here; what is hidden stands above all that is not
            while stack.top.hidden:
                stack.cut(len(stack.frames) - 1)
        if tag in _VOID:
            if tag == "br":
                shown(" ")
            continue
        names = tuple(sorted({w for v in _NAMES.findall(attributes) for w in _WORDS.findall(v.lower())})) if attributes else ()
        key = (id(stack.top), tag, names)
        frame = made.get(key)
        if frame is None:
            frame = made[key] = Frame(tag, (tag, names), stack.top, stack.active)
        stack.push(frame)
        if tag in _RAW:
            stop, after = _raw_end(page, tag, pos)
            if not frame.hidden:
                shown(page[pos:stop])
            pos = after
            stack.cut(len(stack.frames) - 1)
            flush()
    flush()
    return found


def _text_features(text: str, block: str, linked: float, at: int, of: int) -> list[str]:
    words = text.count(" ") + 1
    length = sum(words >= k for k in _LENGTHS)
    last = text[-1]
    return [
        "bias", f"tag={block}", f"len={length}", f"link={min(4, int(linked * 5))}", f"len,link={length},{linked > 0.5}",
        "end=" + ("stop" if last in ".!?" else "mark" if not last.isalnum() else "word"), f"len,end={length},{last in '.!?'}",
        "sign" if "©" in text or "|" in text or "»" in text or "·" in text else "plain", f"comma={min(3, text.count(','))}",
        "first" if at == 0 else "last" if at == of - 1 else "inner",
    ]


def features(page: str) -> tuple[list[str], list[list[str]]]:
    """Texts and features of the page's blocks."""
    found = blocks(page)
    return [b[0] for b in found], [[*b[1].features, *_text_features(b[0], b[2], b[3], i, len(found))] for i, b in enumerate(found)]


class Field:
    """Weights of a two-label chain: for label 1 against 0 by feature, and for each pair of neighbouring labels."""

    def __init__(self, weights: dict[str, float], pairs: list[list[float]]):
        self.weights, self.pairs = weights, pairs

    def decode(self, page: str) -> list[str]:
        """Texts of the main blocks."""
        found = blocks(page)
        scores, weights, known = [], self.weights, {}
        for i, (text, frame, block, linked) in enumerate(found):
            path, at = [], frame
            while at is not None and id(at) not in known:
                path.append(at)
                at = at.above
            above = known[id(at)] if at is not None else 0.0
            for at in reversed(path):
                above += sum(weights.get(f, 0.0) for f in at.fresh)
                known[id(at)] = above
            above = known[id(frame)]
            scores.append(above + sum(weights.get(f, 0.0) for f in _text_features(text, block, linked, i, len(found))))
        return [b[0] for b, label in zip(found, self.viterbi(scores), strict=True) if label]

    def viterbi(self, scores: list[float]) -> list[int]:
        if not scores:
            return []
        (p00, p01), (p10, p11) = self.pairs
        zero, one, back = 0.0, scores[0], []
        for s in scores[1:]:
            from0, from1 = zero + p00 < one + p10, zero + p01 < one + p11
            back.append((from0, from1))
            zero, one = (one + p10 if from0 else zero + p00), s + (one + p11 if from1 else zero + p01)
        labels = [int(one > zero)]
        for steps in reversed(back):
            labels.append(int(steps[labels[-1]]))
        return labels[::-1]


def train(pages: list[tuple[str, list[bool]]], *, epochs: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> Field:
    """Stochastic gradient ascent (with per-weight rates) on the chain's likelihood of labelled pages: (html, label of each leaf block)."""
    ids: dict[str, int] = {}
    data = []
    for page, labels in pages:
        rows = [[ids.setdefault(f, len(ids)) for f in row] for row in features(page)[1]]
        if len(rows) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(rows)} blocks")
        if rows:
            data.append((np.concatenate([np.array(r) for r in rows]), np.cumsum([0] + [len(r) for r in rows])[:-1], np.array(labels, int), np.array([len(r) for r in rows])))
    w, g2 = np.zeros(len(ids)), np.full(len(ids), 1e-2)
    pairs, p2 = np.zeros((2, 2)), np.full((2, 2), 1e-2)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for flat, starts, labels, sizes in data:
            s = np.add.reduceat(w[flat], starts)
            n = len(s)
            node = np.stack([np.zeros(n), s], axis=1)
            ahead, behind = np.empty((n, 2)), np.zeros((n, 2))
            ahead[0] = node[0]
            for i in range(1, n):
                ahead[i] = node[i] + np.logaddexp(ahead[i - 1, 0] + pairs[0], ahead[i - 1, 1] + pairs[1])
            for i in range(n - 2, -1, -1):
                nxt = node[i + 1] + behind[i + 1]
                behind[i] = np.logaddexp(pairs[:, 0] + nxt[0], pairs[:, 1] + nxt[1])
            total = np.logaddexp(*ahead[-1])
            own = np.exp(ahead[:, 1] + behind[:, 1] - total)
            grad = np.zeros_like(w)
            np.add.at(grad, flat, np.repeat(labels - own, sizes))
            touched = np.unique(flat)
            step = grad[touched] - decay * w[touched]
            g2[touched] += step**2
            w[touched] += rate * step / np.sqrt(g2[touched])
            if n > 1:
                both = np.exp(ahead[:-1, :, None] + pairs[None] + (node[1:] + behind[1:])[:, None, :] - total)
                seen = np.zeros((2, 2))
                np.add.at(seen, (labels[:-1], labels[1:]), 1)
                step = seen - both.sum(axis=0) - decay * pairs
                p2 += step**2
                pairs += rate * step / np.sqrt(p2)
    return Field({f: float(w[i]) for f, i in ids.items()}, pairs.tolist())


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts with the label of each leaf block: True for the article's."""
    rng = random.Random(seed)
    syllables = "an be co da el fi go ha in ju ka lo me no or pa qui re sa to un va wi xe yo zu é ö ñ".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.choice((1, 2, 2, 3, 3, 4))))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        text = words(*rng.choice(((1, 3), (4, 12), (8, 25))))
        return text[:1].upper() + text[1:] + rng.choice((".", ".", ".", "!", "?", "", "&amp;", "***"))

    def passage() -> str:
        return " ".join(sentence() for _ in range(rng.choice((1, 1, 2, 4, 7))))

    def name(*choices: str) -> str:
        k = rng.choice(choices)
        return rng.choice((f' class="{k}"', f' id="{k}"', f' class="{k} {word()}"', f" class='{word()}-{k}'", f' class="{k}__{word()}"'))

    def link() -> str:
        return f'<a href="/{word()}">{words(1, 4)}</a>'

    def page() -> tuple[str, list[bool]]:
        labels: list[bool] = []

        def put(markup: str, label: bool) -> str:
            labels.extend([label] * len(blocks(markup)))
            return markup

        def menu() -> str:
            tag, extra = rng.choice((("nav", ""), ("nav", name("menu", "navigation")), ("div", name("nav", "menu", "navbar", "breadcrumb", "toc"))))
            inner = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
            return put(f"<{tag}{extra}>{rng.choice((f'<ul>{inner}</ul>', f'<ol>{inner}</ol>', ' | '.join(link() for _ in range(4))))}</{tag}>", False)

        def advert() -> str:
            extra = name("ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo")
            tag = rng.choice(("div", "div", "aside", "section"))
            return put(f"<{tag}{extra}>{rng.choice((passage(), link(), words(2, 9), sentence() + link()))}</{tag}>", False)

        def notice() -> str:
            extra = rng.choice((name("notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "warning", "paywall"), ' role="alert"', ' role="dialog"'))
            return put(f"<{(t := rng.choice(('div', 'section', 'aside')))}{extra}><p>{passage()}</p>{rng.choice(('', f'<button>{words(1, 2)}</button>'))}</{t}>", False)

        def form() -> str:
            return put(f"<form{rng.choice(('', name('search', 'newsletter', 'subscribe', 'login', 'signup')))}><label>{words(1, 4)}</label><input name=q><p>{sentence()}</p><button>{words(1, 2)}</button></form>", False)

        def sidebar() -> str:
            tag, extra = rng.choice((("aside", ""), ("aside", name("sidebar")), ("div", name("sidebar", "widget", "related", "rail", "recommended", "popular"))))
            return put(f"<{tag}{extra}><h3>{words(1, 4)}</h3>" + "".join(rng.choice((f"<p>{passage()}</p>", f"<ul><li>{link()}</li><li>{link()}</li></ul>", f"<div>{link()}</div>")) for _ in range(rng.randint(1, 4))) + f"</{tag}>", False)

        def share() -> str:
            return put(f"<div{name('share', 'social', 'tags', 'pagination', 'byline', 'meta')}>{' '.join(link() for _ in range(rng.randint(1, 4)))}</div>", False)

        def comments() -> str:
            tag, extra = rng.choice((("section", name("comments", "comment", "responses", "discussion", "disqus")), ("div", name("comments", "comment-list", "replies", "reader-comments")), ("ol", name("commentlist", "comments"))))
            item = rng.choice(("li", "li", "div")) if tag != "ol" else "li"
            rows = "".join(rng.choice((f"<{item}{name('comment', 'reply')}><p>{passage()}</p></{item}>", f"<{item}><b>{word()}</b><p>{passage()}</p></{item}>", f'<article class="comment"><p>{passage()}</p></article>' if tag != "ol" else f"<li><p>{passage()}</p></li>")) for _ in range(rng.randint(1, 5)))
            head = f"<h3>{words(1, 3)}</h3>" if tag != "ol" else ""
            return put(f"<{tag}{extra}>{head}{rows}</{tag}>", False)

        def article() -> str:
            tag, extra = rng.choice((("article", ""), ("article", ""), ("article", name("post", "entry", "story", "hentry")), ("main", ""), ("div", name("content", "article", "post", "entry", "story", "body", "main", "text")), ("section", name("content", "article", "story")), ("td", name("content", "main"))))
            wrap = rng.choice(("", "", "<div>", f"<div{name('content', 'body', 'text', 'wrap', 'inner')}>"))
            parts = []
            if rng.random() < 0.85:
                head = put(f"<h1>{rng.choice((words(2, 10), sentence()))}</h1>", True)
                parts.append(f"<header>{head}</header>" if rng.random() < 0.15 else head)
            for _ in range(rng.choice((1, 2, 4, 8, 14))):
                kind = rng.random()
                if kind < 0.62:
                    text = passage()
                    parts.append(put(rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{sentence()} <a href=x>{words(1, 3)}</a> {text}</p>", f"<p><em>{words(1, 3)}</em> {text}</p>", f"<div>{text}</div>")), True))
                elif kind < 0.7:
                    parts.append(put(f"<h{rng.randint(2, 4)}>{words(1, 6)}</h2>", True))
                elif kind < 0.77:
                    parts.append(put("<ul>" + "".join(f"<li>{rng.choice((words(1, 6), sentence(), passage()))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>", True))
                elif kind < 0.81:
                    parts.append(put(f"<blockquote><p>{passage()}</p></blockquote>", True))
                elif kind < 0.84:
                    parts.append(put("<table><tr>" + "".join(f"<td>{words(1, 3)}</td>" for _ in range(4)) + "</tr></table>", True))
                elif kind < 0.87:
                    parts.append(put(f"<pre>{words(2, 9)}\n{words(2, 9)}</pre>", True))
                elif kind < 0.93:
                    parts.append(rng.choice((advert, advert, share, form, notice))())
                else:
                    parts.append(put(f"<figure><img src=a><figcaption>{sentence()}</figcaption></figure>", True))
            if rng.random() < 0.15:
                parts.append(rng.choice((comments, share, sidebar, menu))())
            inside = wrap + "".join(parts) + ("</div>" if wrap else "")
            return f"<table><tr><td{extra}>{inside}</td></tr></table>" if tag == "td" else f"<{tag}{extra}>{inside}</{tag}>"

        before = [f() for f in (lambda: put(rng.choice((f"<header><p>{words(1, 4)}</p></header>", f"<div{name('header', 'masthead', 'topbar')}><p>{words(1, 5)}</p></div>", f"<header{name('site')}>{link()}<p>{sentence()}</p></header>")), False), menu, notice, advert, form, sidebar) if rng.random() < 0.45]
        middle = article()
        after = [f() for f in (share, comments, sidebar, advert, menu, form, notice) if rng.random() < 0.35]
        foot = put(rng.choice((f"<footer>&copy; {word()}.example &middot; {sentence()}</footer>", f"<footer><p>{sentence()}</p><ul><li>{link()}</li></ul></footer>", f"<div{name('footer', 'copyright', 'legal')}>&copy; {words(1, 5)}</div>")), False) if rng.random() < 0.9 else ""
        wrap = rng.choice((("", ""), ("", ""), ("<div>", "</div>"), (f"<div{name('page', 'wrapper', 'container', 'site')}>", "</div>")))
        head = f"<head><title>{words(2, 6)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{wrap[0]}{''.join(before)}{middle}{''.join(after)}{foot}{wrap[1]}</body></html>", labels

    return [page() for _ in range(n)]


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def main_text(page: str | None, field: Field) -> str:
    return "\n".join(field.decode(page or ""))


def extract(pages: DataFrame, *, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every row of `pages` (page_id, url, html)."""
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [field.decode(v.as_py() or "") for v in batch.column(2)]
            texts = ["\n".join(k) for k in kept]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, kept), pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
