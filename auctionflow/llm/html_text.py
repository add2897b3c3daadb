"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from auctionflow.llm.common import pick

#: Elements that begin and end a block, that have no content, whose text is no text,
#: and those that a new one of the same kind ends.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre search section
select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                "th": {"td", "th"}, "option": {"option"}}
#: Elements in which a paragraph that was left open can't go on.
ENDS_P = BLOCK - {"button", "label", "option", "select"}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+""")
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
ANCESTORS, NAMED = 64, 256  # features come from so many of the nearest ancestors, and so many words of each
NAMES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Block:
    """A run of text between the bounds of block elements."""

    __slots__ = ("text", "path", "linked", "tag")

    def __init__(self, text: str, path: tuple[str, ...], linked: int, tag: str):
        self.text, self.path, self.linked, self.tag = text, path, linked, tag


def tags(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, name, whether it is an end tag, its attributes) of the tags of a page, in order; comments,
    declarations, scripts and styles have no name.

    Every part of a page is read a bounded number of times, however broken it is. A tag whose quotes
    don't end, or hide the rest of the page's `>`, ends at the next `>`; what has none is text."""
    at, quoted = 0, True
    last = page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, None, False, ""
            continue
        if start > last:
            return  # nothing that follows ends
        if page.startswith(("<!", "<?"), start):
            at = page.index(">", start) + 1
            yield start, at, None, False, ""
            continue
        tag = TAG.match(page, start)
        if tag is None:
            at = start + 1
            continue
        name, end = tag[2].lower(), -1
        if quoted:
            end = page.find(">", ATTRIBUTES.match(page, tag.end()).end())
            quoted = end >= 0  # else it would be so for many a tag after this one
        if end < 0:
            end = page.find(">", tag.end())
        if end < 0:
            return
        rest, at = page[tag.end():end], end + 1
        if name in RAW_END and not tag[1]:
            closed = RAW_END[name].search(page, at)
            at = closed.end() if closed else len(page)
            yield start, at, None, False, ""
        else:
            yield start, at, name, bool(tag[1]), rest


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with decoded text and the features of their ancestors."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = [("", (), 0)]  # name, features of the path, how many are its own
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, stack[-1][1], min(linked, len(text)), stack[-1][0]))
        pieces.clear()
        linked = 0

    def close() -> None:
        opened[stack.pop()[0]] -= 1

    for start, end, name, ends, rest in tags(page):
        if start > at:
            pieces.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if name is None:
            continue
        if name == "a":
            in_link = 0 if ends else 1
        elif name == "br":
            pieces.append(" ")
        if name not in BLOCK:
            continue
        flush()
        if ends:
            if opened.get(name):
                while stack[-1][0] != name:
                    close()
                close()
            continue
        if name in ENDS_P and stack[-1][0] == "p" or stack[-1][0] in SELF_CLOSING.get(name, ()):
            close()
        if name not in VOID:
            words = [w.lower() for value in NAMES.finditer(rest) for w in WORDS.findall(value[1] or value[2] or value[3] or "")][:NAMED]
            own = (f"in:{name}", *(f"word:{w}" for w in words), *(f"stem:{w[:4]}" for w in words if len(w) > 3))
            path = stack[-1][1]
            if len(stack) > ANCESTORS:
                path = path[stack[-ANCESTORS][2]:]
            stack.append((name, path + own, len(own)))
            opened[name] = opened.get(name, 0) + 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def text_features(block: Block) -> list[str]:
    n, words = len(block.text), block.text.count(" ") + 1
    return [f"tag:{block.tag}", f"long:{min(9, n.bit_length())}", f"words:{min(7, words.bit_length())}",
            f"linked:{4 * block.linked // n}", f"ended:{block.text[-1] in '.!?:;…' or block.text[-1] == chr(34)}",
            f"mark:{'©' in block.text or '|' in block.text or '·' in block.text}"]


class Crf:
    """Two labels in a chain: a weight per feature for `main` over `other`, and one per transition.

    State 1 is main text. Weights are in natural logarithms."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]
        self.first = [0.0, 0.0]
        self.paths: dict[tuple[str, ...], float] = {}

    def emission(self, block: Block) -> float:
        known = self.paths.get(block.path)
        if known is None:
            if len(self.paths) > 20_000:
                self.paths.clear()
            known = self.paths[block.path] = sum(self.weights.get(f, 0.0) for f in block.path)
        return known + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def viterbi(self, scores: list[float]) -> list[int]:
        """The most likely labels for the emissions of `main`; of equal ones the earlier `other`."""
        if not scores:
            return []
        a, b = self.first[0], self.first[1] + scores[0]
        (m00, m01), (m10, m11) = self.moves
        back = []
        for s in scores[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10), s + max(a + m01, b + m11)
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """Probability of `main` per block, and expected transitions, by forward and backward sums."""
        def add(x: float, y: float) -> float:
            top = max(x, y)
            return top + math.log(math.exp(x - top) + math.exp(y - top))

        (m00, m01), (m10, m11) = self.moves
        ahead = [(self.first[0], self.first[1] + scores[0])]
        for s in scores[1:]:
            a, b = ahead[-1]
            ahead.append((add(a + m00, b + m10), s + add(a + m01, b + m11)))
        total = add(*ahead[-1])
        behind, moves, main = (0.0, 0.0), [[0.0, 0.0], [0.0, 0.0]], [0.0] * len(scores)
        for i in range(len(scores) - 1, -1, -1):
            main[i] = math.exp(ahead[i][1] + behind[1] - total)
            if i:
                a, b, s = *ahead[i - 1], scores[i]
                for x, before in ((0, a), (1, b)):
                    for y, gain in ((0, behind[0]), (1, behind[1] + s)):
                        moves[x][y] += math.exp(before + self.moves[x][y] + gain - total)
                behind = (add(m00 + behind[0], m01 + s + behind[1]), add(m10 + behind[0], m11 + s + behind[1]))
        return main, moves

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4, seed: int = 5) -> Crf:
        """Maximum likelihood by steps along the gradient of one page at a time, sized per weight by
        the squares seen so far."""
        seen: dict = {}
        order = random.Random(seed)
        ready = [([[*b.path, *text_features(b)] for b in page], labels) for page, labels in pages if page]

        def move(at: object, key: object, gradient: float) -> None:
            g = gradient - l2 * at[key]
            name = (id(at), key)
            seen[name] = seen.get(name, 1e-6) + g * g
            at[key] += rate * g / math.sqrt(seen[name])

        for _ in range(epochs):
            order.shuffle(ready)
            for features, labels in ready:
                scores = [sum(self.weights.get(f, 0.0) for f in fs) for fs in features]
                main, moves = self.marginals(scores)
                gradient: dict[str, float] = {}
                for fs, p, y in zip(features, main, labels):
                    for f in fs:
                        gradient[f] = gradient.get(f, 0.0) + y - p
                for f, g in gradient.items():
                    self.weights.setdefault(f, 0.0)
                    move(self.weights, f, g)
                for x, y in zip(labels, labels[1:]):
                    moves[x][y] -= 1
                for x in (0, 1):
                    for y in (0, 1):
                        move(self.moves[x], y, -moves[x][y])
                move(self.first, 1, labels[0] - main[0])
        self.paths.clear()
        return self

    def main_text(self, page: str | None) -> str:
        found = blocks(page or "")
        labels = self.viterbi([self.emission(b) for b in found])
        return "\n".join(b.text for b, y in zip(found, labels) if y)


#: Names that pages give to parts which are not the article, and to the article.
OTHER_PARTS = {
    "nav": ["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "topbar", "toc", "pagination", "skip"],
    "header": ["header", "masthead", "site-header", "branding", "page-header", "top"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "credits", "colophon"],
    "aside": ["sidebar", "side-bar", "widget", "related", "recommended", "popular", "trending", "rail", "aside", "read-more"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "promotion", "sponsor"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "modal", "gdpr", "paywall", "disclaimer", "overlay"],
    "form": ["newsletter", "subscribe", "signup", "search", "login", "contact-form", "subscription"],
    "comments": ["comments", "comment", "comment-list", "reader-comments", "discussion", "replies", "reply", "disqus", "responses", "user-comments"],
    "share": ["share", "social", "sharing", "tags", "byline-links", "tools", "buttons"],
}
MAIN_PARTS = ["article", "content", "main-content", "post", "post-body", "entry-content", "story", "article-body", "body-text", "text"]


def labelled_page(texts: list[str], main: list[str], draw: random.Random) -> str:
    """A page of known parts in one of many layouts, its main blocks marked by a leading \\x01.

    Headings and paragraphs of the article come from `main`, everything else from `texts`."""
    def some(n: int) -> list[str]:
        return [html.escape(draw.choice(texts)) for _ in range(n)]

    def short() -> str:
        return " ".join(html.escape(draw.choice(texts)).split()[:draw.randint(1, 5)]) or "x"

    def named(kind: str) -> str:
        return f'{draw.choice(["class", "id"])}="{draw.choice(OTHER_PARTS[kind])}"'

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/">{short()}</a></li>' for _ in range(n)) + "</ul>"

    def part(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        if kind == "comments":
            tag = draw.choice(["section", "div", "ol", "aside"])
        start = f"<{tag} {named(kind)}>" if tag == "div" or kind == "comments" or draw.random() < 0.5 else f"<{tag}>"
        if tag in ("nav", "header", "footer", "aside") and draw.random() < 0.2:
            tag = "div"
            start = f"<div {named(kind)}>"
        if kind == "nav":
            inner = links(draw.randint(2, 8))
        elif kind == "footer":
            inner = draw.choice(["", "<p>"]) + f"&copy; {short()} &middot; {draw.choice(some(1))}"
        elif kind == "header":
            inner = draw.choice([f"<a href='/'>{short()}</a>", f"<h1>{short()}</h1><p>{short()}", f"<div>{short()}</div>{links(3)}"])
        elif kind == "aside":
            inner = f"<h3>{short()}</h3>" + draw.choice([links(4), "".join(f"<p>{t}</p>" for t in some(2)), *some(1)])
        elif kind == "form":
            inner = f"<label>{short()}</label><input><p>{draw.choice(some(1))}</p><button>{short()}</button>"
        elif kind == "comments":
            inner = f"<h3>{short()}</h3>" + "".join(f'<{draw.choice(["div", "li", "article"])} class="{draw.choice(["comment", "reply", "comment-body"])}"><b>{short()}</b><p>{t}</p>' for t in some(draw.randint(1, 4)))
        else:
            inner = "".join(draw.choice([f"<p>{t}</p>", f"<div>{t}</div>", t]) for t in some(draw.randint(1, 2)))
        return f"{start}{inner}</{tag}>"

    tag = draw.choice(["article", "article", "article", "main", "div", "section"])
    name = f'class="{draw.choice(MAIN_PARTS)}"' if tag == "div" or draw.random() < 0.3 else ""
    body = []
    for i, text in enumerate(main):
        wrap = draw.choice(["h1", "h2"]) if i == 0 else draw.choice(["p"] * 12 + ["h2", "h3", "blockquote", "li", "pre", "td", "div"])
        text = "\x01" + html.escape(text)
        body.append(draw.choice([f"<{wrap}>{text}</{wrap}>", f"<{wrap}><b>{text}<br>", f"<{wrap}>{text}"]) if wrap == "p" else f"<{wrap}>{text}</{wrap}>")
        if draw.random() < 0.15:
            body.append(part(draw.choice(["ad", "share", "aside", "notice", "form", "nav"])))
    inside = draw.random() < 0.5
    tail = part("comments") if draw.random() < 0.5 else ""
    article = f"<{tag} {name}>" + "".join(body) + (tail if inside else "") + f"</{tag}>" + ("" if inside else tail)
    before = [part(k) for k in ("notice", "header", "nav", "ad", "aside") if draw.random() < 0.5]
    after = [part(k) for k in ("share", "aside", "ad", "form", "notice") if draw.random() < 0.35]
    if draw.random() < 0.3:
        article = f'<div class="{draw.choice(["container", "wrapper", "page", "row", "layout"])}">{article}{"".join(after[:1])}</div>'
        after = after[1:]
    head = f"<head><title>{short()}</title></head>" if draw.random() < 0.7 else ""
    if draw.random() < 0.7:
        after.append(part("footer"))
    return f"<html>{head}<body>{''.join(before)}{article}{''.join(after)}</body></html>"


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 300, made: int = 1200, seed: int = 11) -> Crf:
    """A field trained on `made` labelled pages from the texts of at most `sample` pages.

    The table has no labels. So the blocks of a sample, chosen by a hash of the page's id, are taken
    as texts (of their first 600 characters where they serve as menus, notices and the like), and pages are
    laid out from them in turn with parts whose labels are known (see `labelled_page`): articles of varied length between, and with, menus, notices,
    adverts, forms, comments and the like, under many names and elements."""
    given = pick(pages, id_col, html_col).filter(F.col(f"`{html_col}`").isNotNull())
    place = F.xxhash64(f"`{id_col}`")
    # about twice as many as wanted are looked at, so that each task sends the driver its share only
    near = F.pmod(place, F.lit(1 << 40)) < (2 * sample << 40) // max(1, given.count(), 2 * sample)
    rows = given.filter(near).orderBy(place, F.col(f"`{html_col}`")).limit(sample).collect()
    draw = random.Random(seed)
    texts = [[b.text for b in blocks(r[1])] for r in rows]
    pool = [t[:600] for found in texts for t in found] or ["text of a page."]
    labelled = []
    for i in range(made):
        found = (texts[i % len(texts)] if texts else None) or pool
        main = [draw.choice(found) for _ in range(draw.randint(1, 12))]
        page = blocks(labelled_page(pool, main, draw))
        labels = [int("\x01" in b.text) for b in page]
        for b in page:
            b.text = b.text.replace("\x01", "") or "x"
        labelled.append((page, labels))
    return Crf().fit(labelled)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", field: Crf | None = None) -> DataFrame:
    """`pages` with a `text` column (one of that name is replaced): the blocks that the field takes
    for main text, joined by line breaks.

    A block is the text between the bounds of block elements, with character references decoded and
    white space turned into single spaces; comments, scripts and styles are no text. Broken markup is
    read as far as it goes, in time that grows with the page: open elements end with the page, open quotes at the next `>`. A NULL, empty
    or text-free page gives an empty text. Pages are read whole, one by one, without a shuffle;
    repeated rows give equal rows, an empty table none."""
    field = field or train(pages, id_col, html_col)
    pages = pages.drop("text")
    at, shared = pages.columns.index(html_col), pages.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                texts = pa.array([shared.value.main_text(p.as_py()) for p in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "text"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("text", StringType())]))


def digest(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
