"""HTML extraction (operator 5): a linear-chain CRF over DOM leaf blocks.

A page is parsed into leaf blocks (text between block-level tags) with features of their
ancestors' tags, of words in their class, id and role, and of their text. A conditional
random field labels each block main or boilerplate; it is trained by gradient ascent on
labelled pages and decoded by Viterbi. The labelled pages are made by ``labelled_pages``:
page skeletons of many kinds whose blocks are labelled as they are written.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page: no markup, or not shown.
RAW = frozenset("script style textarea title iframe noembed noframes noscript template svg xmp".split())
#: Tags that end an open element of the same set.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HARD = frozenset("article section div main aside nav table td body header footer form ul ol".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+", re.I)


class Block:
    __slots__ = ("feats", "links", "text")

    def __init__(self, text: str, feats: list[str], links: int):
        self.text, self.feats, self.links = text, feats, links


def parse(page: str, known: frozenset | None = None) -> list[Block]:
    """Leaf blocks in page order. Ancestor features outside known are left out as the tags are read."""
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    active: dict[str, int] = {}
    opened: dict[str, int] = {}
    parts: list[str] = []
    links = link_from = size = 0
    in_link = False

    def flush():
        nonlocal parts, links, size, link_from
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            parent = next((t for t, _ in reversed(stack) if t not in INLINE), "none")
            blocks.append(Block(text, ["in:" + parent, *active], links + (size - link_from if in_link else 0)))
        parts, links, size, link_from = [], 0, 0, 0

    def pop():
        tag, feats = stack.pop()
        opened[tag] -= 1
        for f in feats:
            active[f] -= 1
            if not active[f]:
                del active[f]

    at, n = 0, len(page)
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            size += len(piece)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        closing = bool(m[1] or m[4])
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                if in_link:
                    links += size - link_from
                in_link, link_from = not closing, size
            continue
        flush()
        if closing:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            if tag in HARD:
                in_link = False
            continue
        if tag in RAW:
            if tag == "svg" and (m[3] or m[6] or "").endswith("/"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if tag in CLOSES or tag in ENDS_P:
            ends = CLOSES.get(tag, {"p"})
            while stack and stack[-1][0] in ends:
                pop()
        feats = ["tag:" + tag]
        for a in _ATTR.finditer(m[3] or m[6] or ""):
            feats += ["name:" + w.lower() for w in _NAME.findall(a[2] or a[3] or a[4] or "")]
        feats = tuple(f for f in dict.fromkeys(feats) if known is None or f in known)
        stack.append((tag, feats))
        opened[tag] = opened.get(tag, 0) + 1
        for f in feats:
            active[f] = active.get(f, 0) + 1
    if at < n:
        parts.append(page[at:])
        size += n - at
    flush()
    return blocks


_NOTICE = re.compile(r"cookie|privacy|subscri|newsletter|sign in|log in|copyright|all rights|advert|sponsor|consent|share|comment", re.I)


def text_feats(b: Block, i: int, n: int) -> list[str]:
    t = b.text
    words = t.count(" ") + 1
    out = [f"words:{min(words.bit_length(), 7)}", f"first:{i == 0}", f"last:{i == n - 1}"]
    density = min(b.links, len(t)) / len(t)
    out.append(f"links:{0 if not density else 1 if density < 0.4 else 2 if density < 0.9 else 3}")
    stops = sum(map(t.count, ".!?,;"))
    out.append(f"stops:{min(3, 8 * stops // words)}")
    out.append(f"ends:{t[-1] in '.!?:”»"'}")
    if "©" in t or "|" in t or "·" in t:
        out.append("mark")
    notices = len(_NOTICE.findall(t))
    if notices:  # how many there are for the words of the whole block
        out.append(f"notice:{min(3, 16 * notices // words)}")
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    n = len(blocks)
    return [["bias", *b.feats, *text_feats(b, i, n)] for i, b in enumerate(blocks)]


class Crf:
    """Labels 0 (boilerplate) and 1 (main): weights of features for label 1 over label 0, transitions, and start weights."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.index, self.weights, self.trans, self.start = index, weights.tolist(), trans.tolist(), start.tolist()
        self.known = frozenset(index)

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not feats:
            return []
        index, weights = self.index, self.weights
        (t00, t01), (t10, t11) = self.trans
        a, b = self.start
        back = []
        for k, f in enumerate(feats):
            e = sum([weights[index[x]] for x in f if x in index])
            if k == 0:
                b += e
                continue
            from0 = (0, a + t00) if a + t00 >= b + t10 else (1, b + t10)
            from1 = (0, a + t01) if a + t01 > b + t11 else (1, b + t11)
            back.append((from0[0], from1[0]))
            a, b = from0[1], from1[1] + e
        label = int(b > a)
        out = [label]
        for p in reversed(back):
            label = p[label]
            out.append(label)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        blocks = parse(page, self.known)
        return "\n\n".join(b.text for b, y in zip(blocks, self.decode(features(blocks)), strict=True) if y)


def train(pages: Iterable[tuple[list[list[str]], list[int]]], rounds: int = 300, rate: float = 0.5, l2: float = 0.01) -> Crf:
    """Maximum conditional likelihood with an L2 prior, by AdaGrad over forward and backward sums of all pages at once."""
    pages = [p for p in pages if p[1]]
    index: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for x in f:
                index.setdefault(x, len(index))
    count, longest = len(pages), max(len(y) for _, y in pages)
    y = np.zeros((count, longest), np.int64)
    mask = np.zeros((count, longest), bool)
    cell, feat = [], []
    for p, (feats, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
        mask[p, : len(labels)] = True
        for i, f in enumerate(feats):
            cell += [p * longest + i] * len(f)
            feat += [index[x] for x in f]
    cell, feat = np.array(cell), np.array(feat)
    w, trans, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full_like(v, 1e-6) for v in (w, trans, start)]
    pair = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    first = np.bincount(y[:, 0], minlength=2)
    live = mask.T[:, :, None]
    for _ in range(rounds):
        e = np.ones((longest, count, 2))
        e[:, :, 1] = np.exp(np.bincount(cell, w[feat], count * longest)).reshape(count, longest).T
        step = np.exp(trans)
        # scaled forward and backward sums; a page that has ended keeps its last forward row
        fwd, scale = np.empty((longest, count, 2)), np.ones((longest, count, 1))
        fwd[0] = np.exp(start) * e[0]
        fwd[0] /= fwd[0].sum(1, keepdims=True)
        for t in range(1, longest):
            new = (fwd[t - 1] @ step) * e[t]
            scale[t] = np.where(live[t], new.sum(1, keepdims=True), 1)
            fwd[t] = np.where(live[t], new / scale[t], fwd[t - 1])
        bwd = np.ones((longest, count, 2))
        for t in range(longest - 2, -1, -1):
            bwd[t] = np.where(live[t + 1], (e[t + 1] * bwd[t + 1] / scale[t + 1]) @ step.T, 1)
        main = (fwd * bwd)[:, :, 1].T * mask
        ahead = np.where(live[1:], e[1:] * bwd[1:] / scale[1:], 0)
        both = np.einsum("tpi,tpj->ij", fwd[:-1], ahead) * step
        p0 = (fwd[0] * bwd[0]).sum(0)
        grads = (np.bincount(feat, (y * mask - main).reshape(-1)[cell], len(index)) - l2 * w, seen - both - l2 * trans, first - p0 - l2 * start)
        for v, g, s in zip((w, trans, start), grads, sums, strict=True):
            s += g * g
            v += rate * g / np.sqrt(s)
    return Crf(index, w, trans, start)


# labelled pages

_SYLLABLES = "an be co du en fi ga hi in jo ka le mi no or pa qu re su ti un va wo ya ze th sch eau ção é ü".split()
_MAIN = ["article", "main", "div class=content", "div id=content", "div class='post-content entry'", "div class=article-body", "section class=story", "div role=main", "div itemprop=articleBody", "td class=body", "div id=main", "div", "div class=text", "div class='post hentry'"]
_NAVS = ["nav", "div class=menu", "div id=nav", "ul class='nav navbar'", "div class=navigation", "div class=breadcrumb", "div role=navigation", "div id=menu", "div class=topbar"]
_HEADS = ["header", "div id=header", "div class=site-header", "div role=banner", "div class=masthead", "div class=head"]
_FOOTS = ["footer", "div id=footer", "div class='site-footer'", "div role=contentinfo", "div class=copyright", "div class=bottom"]
_SIDES = ["aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class='related posts'", "div role=complementary", "section class=recommended", "div class=right-column", "div class=tags", "div class='share social'", "div class='author-bio'"]
_NOTES = ["div class=cookie-banner", "div id=cookie", "div class=notice", "div class='alert banner'", "div class=newsletter", "div class=popup", "div class=modal", "div class=consent", "div role=alert", "div class=subscribe", "div class=paywall", "div class=gdpr"]
_ADS = ["div class=ad", "div class=ads", "div class=advert", "div id=advertisement", "div class=sponsored", "aside class=promo", "div class=banner-ad", "div class=adsbygoogle", "div class='promotion'", "section class=advertorial"]
_FORMS = ["form", "form class=search", "form id=login", "form class=contact-form", "div class=search-form"]
_COMMENTS = ["div class=comments", "section id=comments", "div class=comment-list", "ol class=commentlist", "div id=disqus", "section class=discussion", "div class=responses", "div class='reader-comments'", "div class=replies"]
_INSIDE = ["p", "p", "p", "p", "h2", "h3", "blockquote", "ul", "pre", "table", "figure"]


def labelled_pages(count: int, seed: int = 1, unnamed: float = 0.15) -> list[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text of a leaf block, label)]) for made-up pages of many layouts; unnamed is the share whose containers have names that say nothing."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        page: list[str] = []
        labels: list[tuple[str, int]] = []
        named = rng.random() >= unnamed
        cells = not named and rng.random() < 0.4  # or all is in the cells of one table

        def phrase(lo: int, hi: int, stop: bool) -> str:
            words = ["".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(lo, hi))]
            if stop:
                words = [w + ("." if rng.random() < 0.1 else "," if rng.random() < 0.08 else "") for w in words[:-1]] + [words[-1] + "."]
            if rng.random() < 0.06:
                words = [w + rng.choice(["***", "%%%", "$$$", "&", "!!", "|"]) for w in words]
            return " ".join(words).capitalize()

        def put(open_: str, text: str, label: int, link: bool = False):
            if not label and rng.random() < 0.15:
                text += rng.choice([" cookies", " privacy policy", " all rights reserved", " subscribe", " newsletter", " sign in", " advertisement", " share", " comments", " ©", " | "])
                text = text.strip()
            elif label and rng.random() < 0.01:
                text += " share, comment"
            name = open_.split()[0]
            shown = html.escape(text, quote=False)
            if link:
                shown = f"<a href='/x'>{shown}</a>"
            elif label and rng.random() < 0.3 and " " in shown:
                a, _, b = shown.partition(" ")
                shown = rng.choice([f"<b>{a}</b> {b}", f"{a} <a href=x>{b}</a>" if len(b) < 40 else f"<em>{a}</em> {b}", f"{a}<br>{b}", f"<b>{a} {b}"])
            page.append(f"<{open_}>{shown}" + (f"</{name}>" if rng.random() < 0.93 or name not in ("p", "li") else ""))
            labels.append((" ".join(text.split()), label))

        def plain(open_: str) -> str:
            if named or open_.split()[0] in ("form", "span"):
                return open_
            if cells:
                return "td"
            return rng.choice(["div", "div class=" + rng.choice(_SYLLABLES) + rng.choice(_SYLLABLES), "div id=" + rng.choice(_SYLLABLES), "section"])

        def group(open_: str, fill):
            open_ = plain(open_)
            page.append(f"<{open_}>")
            wrap = rng.random() < 0.3
            if wrap:
                page.append("<div class=inner>")
            fill()
            if wrap:
                page.append("</div>")
            page.append(f"</{open_.split()[0]}>")

        def menu():
            if not named and rng.random() < 0.6:  # links in a row
                links = [phrase(1, 3, False) for _ in range(rng.randrange(2, 7))]
                mark = rng.choice([" | ", " ", " · ", "<br>"])
                page.append("<div>" + mark.join(f"<a href=/x>{html.escape(x, quote=False)}</a>" for x in links) + "</div>")
                labels.append((" ".join(mark.replace("<br>", " ").join(links).split()), 0))
                return
            page.append("<ul>")
            for _ in range(rng.randrange(2, 9)):
                put("li", phrase(1, 4, False), 0, True)
            page.append("</ul>")

        def prose(label: int, lo: int = 1, hi: int = 4):
            for _ in range(rng.randrange(lo, hi)):
                put("p", phrase(5, 70, True), label)

        def short():
            if rng.random() < 0.4:
                put(rng.choice(["p", "div", "span class=x", "h4"]) if rng.random() < 0.8 else "div", phrase(2, 12, rng.random() < 0.6), 0)
            elif rng.random() < 0.5:
                menu()
            else:
                put("h3", phrase(1, 4, False), 0)
                prose(0, 1, 3)

        def bare(kinds, long_: float = 0.3):
            text = phrase(3, 40 if rng.random() < long_ else 14, rng.random() < 0.7)
            put(plain(rng.choice(kinds)), text, 0)

        def form():
            put("p", phrase(1, 8, rng.random() < 0.5), 0)
            page.append("<input name=q><textarea>typed text</textarea>")
            if rng.random() < 0.6:
                put("button", phrase(1, 3, False), 0)
            if rng.random() < 0.3:
                page.append("<select>")
                for _ in range(3):
                    put("option", phrase(1, 3, False), 0)
                page.append("</select>")

        def comments():
            if rng.random() < 0.7:
                put("h3", phrase(1, 4, False), 0)
            for _ in range(rng.randrange(1, 5)):
                group(rng.choice(["div class=comment", "li", "article class=comment", "div"]), lambda: prose(0, 1, 3))

        def body():
            if rng.random() < 0.8:
                put("h1", phrase(2, 12, False), 1)
            terse = rng.random() < 0.12  # an article of short lines
            for _ in range(rng.randrange(5, 50) if terse else rng.randrange(1, 12)):
                kind = "p" if terse else rng.choice(_INSIDE)
                if kind in ("h2", "h3"):
                    put(kind, phrase(1, 8, False), 1)
                elif kind == "ul":
                    page.append("<ul>")
                    for _ in range(rng.randrange(1, 5)):
                        put("li", phrase(1, 20, rng.random() < 0.5), 1)
                    page.append("</ul>")
                elif kind == "table":
                    page.append("<table><tr>")
                    for _ in range(rng.randrange(1, 5)):
                        put("td", phrase(1, 6, False), 1)
                    page.append("</tr></table>")
                elif kind == "figure":
                    page.append("<figure><img src=x>")
                    put("figcaption", phrase(2, 14, True), 1)
                    page.append("</figure>")
                else:
                    brief = terse or rng.random() < 0.25
                    put(kind, phrase(1 if brief else 5, 5 if brief else 90, rng.random() < 0.8), 1)
                if rng.random() < 0.07:
                    bare(_ADS)
                if rng.random() < 0.04:
                    group(rng.choice(_SIDES), short)

        page.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>x('<p>')</script></head><body>")
        if rng.random() < 0.25:
            bare(_NOTES) if rng.random() < 0.5 else group(rng.choice(_NOTES), short)
        if rng.random() < 0.5:
            group(rng.choice(_HEADS), short)
        if rng.random() < 0.7:
            group(rng.choice(_NAVS), menu)
        if rng.random() < 0.5:
            bare(_ADS) if rng.random() < 0.6 else group(rng.choice(_ADS), short)
        if rng.random() < 0.2:
            group(rng.choice(_SIDES), short)
        if rng.random() < 0.15:
            group(rng.choice(_FORMS), form)
        outer = plain(rng.choice(["", "", "main", "div class=container", "div id=wrapper", "section"]) or "div") if rng.random() < 0.67 else ""
        if outer:
            page.append(f"<{outer}>")
        opening = rng.choice(_MAIN if not outer else ["article", *_MAIN])
        late = rng.random() < 0.25
        group(opening, lambda late=late: (body(), group(rng.choice(_COMMENTS), comments) if late and rng.random() < 0.6 else late and group(rng.choice([*_SIDES, *_NOTES, *_FORMS[:2]]), short)))
        if outer:
            page.append(f"</{outer.split()[0]}>")
        for kinds, fill, p in ((_ADS, short, 0.15), (_COMMENTS, comments, 0.4), (_SIDES, short, 0.4), (_FORMS, form, 0.25), (_NOTES, short, 0.25)):
            if rng.random() < p:
                group(rng.choice(kinds), fill)
        if rng.random() < 0.85:
            if rng.random() < 0.6:
                put(plain(rng.choice(_FOOTS)), rng.choice(["© ", "", ""]) + phrase(2, 30, rng.random() < 0.6), 0)
            else:
                group(rng.choice(_FOOTS), short)
        if rng.random() < 0.1:
            bare(_NOTES)
        if rng.random() < 0.9:
            page.append("</body></html>")
        out.append(("".join(page), labels))
    return out


def labelled(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list[list[str]], list[int]]]:
    """Features and labels of the parsed blocks; a page whose blocks don't parse as they were labelled is an error."""
    out = []
    for page, marks in pages:
        blocks = parse(page)
        if [b.text for b in blocks] != [t for t, _ in marks]:
            raise ValueError("a labelled page parses into other blocks")
        out.append((features(blocks), [y for _, y in marks]))
    return out


#: Labelled pages that the model is fitted on.
TRAINING_PAGES = 1200


@lru_cache(maxsize=2)
def model(count: int = TRAINING_PAGES, seed: int = 1) -> Crf:
    return train(labelled(labelled_pages(count, seed)))


def extract(pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """page_id, url, text (the main text, empty if there is none) and n_chars (its code points) of each row of pages.

    A null html is empty. Blocks are labelled in the context of their whole page. Repeated
    rows get the same text. Other columns are left behind.
    """
    crf = crf or model()
    shipped = pages.sparkSession.sparkContext.broadcast(crf)  # some thousand weights

    def run(batches):
        for batch in batches:
            texts = [shipped.value.extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
