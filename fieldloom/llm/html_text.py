"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: pieces of text between block-level tags, each with its ancestors. Features are
the ancestor tags, words of class, id and role names, and figures of the text. The field has two labels (article or
not), is trained on labelled pages by gradient ascent on the likelihood (forward-backward), and decodes by Viterbi. The
labelled pages are written by labelled_page() from a grammar of page layouts.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import widen

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no part of a page's prose: scripts, styles, form controls, graphics and what is never shown.
#: What is in the first holds no tags and ends at its end tag only, or with the page; the others hold elements.
RAW_TAGS = frozenset("script style noscript iframe title textarea".split())
SILENT_TAGS = frozenset("template svg select button datalist annotation annotation-xml".split())
#: No end tag within the first, and no start tag within the second, closes an element around them.
END_BARS, START_BARS = ("template", "object", "select"), ("template", "object", "select", "button")
#: Elements within a line whose end ends the blocks they hold.
HOLDS_BLOCKS = frozenset("object audio video canvas".split())
#: Start tags that end an open svg, but not within those of its elements that hold HTML; tags that end a select.
HTML_WITHIN = ("foreignobject", "desc", "title")
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
ENDS_SELECT = frozenset("select input textarea".split())
#: An open element of the key is closed by a tag of the values (or, for p, by any block).
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_CLOSES = {t: ("p", *(k for k, v in CLOSED_BY.items() if t in v)) for t in BLOCK_TAGS}
_HOLDERS = ("table", "ul", "ol", "dl")
#: Tags whose names are features.
_TOLD_TAGS = BLOCK_TAGS | frozenset("a abbr b cite code em i label q s small span strong sub sup u math object audio video canvas".split())
# No repetition below can be entered twice over the same text, so a tag is read in time in proportion to its length.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'<>=]++))?+)*+)\s*+(/?)>""")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:>|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+)""")
_NAMED = re.compile(r"""\s(?:class|id|role)=(?:"([^"]*+)"|'([^']*+)'|([^\s"']++))""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
_PART = re.compile(r"[a-z]{2,}")
_NO_NAMES: frozenset[str] = frozenset()
_COMMENT_END = re.compile(r"--!?>")
ENDS = tuple(".!?…。！？")


class Context:
    """Where a block is: what its innermost element adds to what the elements around it say."""

    __slots__ = ("parent", "tags", "names", "last", "block")

    def __init__(self, parent: Context | None, tag: str, tags: tuple[str, ...], names: tuple[str, ...]):
        self.parent = parent
        self.tags = tags
        self.names = names
        self.last = tag
        self.block = tag if tag in BLOCK_TAGS else parent.block if parent else ""

    def told(self) -> list[str]:
        """Features of this element that none around it has."""
        return [f"in:{t}" for t in self.tags] + [f"name:{x}" for x in self.names]


class _Open:
    """The open elements. Finding the innermost of a name takes the same time at any depth."""

    def __init__(self):
        self.tags: list[str] = []
        self.contexts: list[Context] = []
        self.at: dict[str, list[int]] = {}
        self.names: dict[str, int] = {}

    def push(self, tag: str, names: set[str] | frozenset[str]) -> None:
        tags = () if tag not in _TOLD_TAGS or self.at.get(tag) else (tag,)
        depth, new = len(self.tags), ()
        if names:
            new = tuple(sorted(x for x in names if x not in self.names))
            for x in new:
                self.names[x] = depth
        self.contexts.append(Context(self.contexts[-1] if depth else None, tag, tags, new))
        if (places := self.at.get(tag)) is None:
            self.at[tag] = [depth]
        else:
            places.append(depth)
        self.tags.append(tag)

    def cut(self, k: int) -> None:
        """Close the k-th element and all within."""
        tags, contexts, at = self.tags, self.contexts, self.at
        while len(tags) > k:
            at[tags.pop()].pop()
            if names := contexts.pop().names:
                for x in names:
                    del self.names[x]

    def last(self, *tags: str) -> int:
        best, get = -1, self.at.get
        for t in tags:
            if (p := get(t)) and p[-1] > best:
                best = p[-1]
        return best


class Block:
    __slots__ = ("text", "context", "link_chars")

    def __init__(self, text: str, context: Context | None, link_chars: int):
        self.text, self.context, self.link_chars = text, context, link_chars


def _read_tag(page: str, at: int) -> tuple[str, bool, set[str] | frozenset[str], bool, int] | None:
    """The tag at a '<' and a letter: name, whether an end tag, words of class, id and role, whether closed by itself,
    and where it ends. None if the page ends within. A quote that is never closed is taken as any other character."""
    m = _TAG.match(page, at)
    if m:
        said, end = m[3], m.end()
        names = {x for n in _NAMED.findall(said) for x in _PART.findall("".join(n).lower())} if said else _NO_NAMES
        return m[2].lower(), bool(m[1]), names, bool(m[4]), end
    m = _TAG_NAME.match(page, at)
    tag, close, names, end = m[1].lower(), page[at + 1] == "/", set(), m.end()
    while a := _ATTRIBUTE.match(page, end):
        name = a[1]
        if name is None:
            return tag, close, names, a[0].endswith("/>"), a.end()
        if name.lower() in ("class", "id", "role"):
            names.update(_PART.findall((a[2] or a[3] or a[4] or "").lower()))
        end = a.end()
    return None


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. Unclosed, misnested and cut-off tags are taken as browsers mostly do.

    Time is in proportion to the page's length: each character is looked at a bounded number of times.
    """
    open_ = _Open()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, open_.contexts[-1] if open_.contexts else None, linked))
            parts.clear()
        linked = 0

    quiet, at, size = -1, 0, len(page)  # place of the outermost silent element that is open; place in the page

    def cut(k: int) -> None:
        nonlocal quiet
        open_.cut(k)
        if quiet >= len(open_.tags):
            quiet = -1

    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            if quiet < 0:
                parts.append(page[at:end])
                if open_.at.get("a"):
                    linked += end - at
            at = end
            continue
        after = page[at + 1 : at + 3]
        if after[:1] in "!?/" and after and not (after[0] == "/" and (len(after) < 2 or after[1].isascii() and after[1].isalpha())):
            if not page.startswith("<!--", at):
                end = page.find(">", at + 2)
                at = size if end < 0 else end + 1
            elif page.startswith((">", "->"), at + 4):  # a comment that ends as soon as it begins
                at = page.index(">", at) + 1
            else:
                ended = _COMMENT_END.search(page, at + 4)
                at = ended.end() if ended else size
            continue
        if not (after[:1].isascii() and after[:1].isalpha() or len(after) == 2 and after[0] == "/"):
            if quiet < 0:
                parts.append("<")
            at += 1
            continue
        read = _read_tag(page, at)
        if read is None:  # the page ends within a tag
            break
        tag, close, names, slash, at = read
        if close:
            k, bar = open_.last(tag), open_.last(*END_BARS)
            if k < bar:
                k = -1
            inside = quiet >= 0 and (k < 0 or k >= quiet)
            if not inside and (tag in BLOCK_TAGS and (k >= 0 or bar < 0) or tag in HOLDS_BLOCKS and k >= 0 and any(t in BLOCK_TAGS for t in open_.tags[k:])):
                flush()
            if k >= 0:
                cut(k)
            continue
        if tag == "head":  # what it may hold is silent or void, and anything else ends it
            continue
        foreign = False
        if open_.at.get("svg"):
            while (foreign := (root := open_.last("svg")) >= 0 and root > open_.last(*HTML_WITHIN)) and tag in BREAKS_OUT:
                cut(root)
        if tag in RAW_TAGS and not foreign:
            if tag == "textarea" and (k := open_.last("select")) >= 0:
                cut(k)
            end = _RAW_END[tag].search(page, at)
            end = page.find(">", end.end()) if end else -1
            at = size if end < 0 else end + 1
            continue
        over = open_.last("select") if tag in ENDS_SELECT else open_.last("button") if tag == "button" else -1
        if over >= 0:
            cut(over)
            if tag == "select":
                continue
        if tag in BLOCK_TAGS and not foreign:
            shut = open_.last(*_CLOSES[tag])
            if 0 <= shut < len(open_.tags) - 1 and (shut < open_.last(*START_BARS) or shut < open_.last(*_HOLDERS)):
                shut = -1
            if quiet < 0 or 0 <= shut < quiet:
                flush()
            if shut >= 0:
                cut(shut)
        elif tag == "br" and quiet < 0:
            parts.append(" ")
        if tag not in VOID_TAGS and not (slash and (tag not in SILENT_TAGS or tag == "svg" or foreign)):
            if quiet < 0 and tag in SILENT_TAGS:
                quiet = len(open_.tags)
            open_.push(tag, names)
    flush()
    return out


def _own(b: Block, k: int, n: int) -> tuple:
    """What the block's own features tell: few different values, however many blocks there are."""
    text, c = b.text, b.context
    chars, words, ends = len(text), text.count(" ") + 1, text.endswith(ENDS)
    sentence = ends and words > 3 and text[0].isupper()
    return min(9, (chars + 1).bit_length() - 1), min(8, words.bit_length() - 1), min(4, 4 * b.link_chars // max(1, chars)), min(4, 5 * k // n), ends, sentence, c and (c.block or c.last)


def _own_features(own: tuple) -> list[str]:
    size, words, link, place, ends, sentence, leaf = own
    out = ["any", f"len{size}", f"words{words}", f"link{link}", f"place{place}", "ends" if ends else "open"]
    return out + ["sentence"] * sentence + ([f"leaf:{leaf}"] if leaf else [])


def features(b: Block, k: int, n: int) -> list[str]:
    """Features of the block itself and of all elements around it."""
    out, c = _own_features(_own(b, k, n)), b.context
    while c:
        out += c.told()
        c = c.parent
    return out


class FieldModel:
    """Weights of a two-label chain: state[feature] = (not article, article), move[from][to], start[label]."""

    def __init__(self, state: dict[str, tuple[float, float]], move, start):
        self.state, self.move, self.start = state, move, start

    def label(self, bs: list[Block]) -> list[int]:
        """Viterbi: the most probable labels; of equals, not article."""
        n = len(bs)
        if not n:
            return []
        (m00, m01), (m10, m11) = self.move
        get, back = self.state.get, []
        a, b = self.start
        around: dict[Context | None, tuple[float, float]] = {None: (0.0, 0.0)}  # what elements add, each once
        alone: dict[tuple, tuple[float, float]] = {}  # what a block's own features add

        def add(names: list[str], e0: float, e1: float) -> tuple[float, float]:
            for f in names:
                if (w := get(f)) is not None:
                    e0 += w[0]
                    e1 += w[1]
            return e0, e1

        for k, x in enumerate(bs):
            chain, c = [], x.context
            while c not in around:
                chain.append(c)
                c = c.parent
            for c in reversed(chain):
                around[c] = add(c.told(), *around[c.parent])
            own = _own(x, k, n)
            if own not in alone:
                alone[own] = add(_own_features(own), 0.0, 0.0)
            (e0, e1), (f0, f1) = around[x.context], alone[own]
            e0, e1 = e0 + f0, e1 + f1
            if k:
                from0, from1 = a + m00 >= b + m10, a + m01 >= b + m11
                back.append((0 if from0 else 1, 0 if from1 else 1))
                a, b = (a + m00 if from0 else b + m10), (a + m01 if from1 else b + m11)
            a, b = a + e0, b + e1
        out = [0 if a >= b else 1]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def _chain_sums(emit: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[list, list]:
    """Probability of each label at each block, and expected moves, by forward and backward sums scaled at each step."""
    p = np.exp(emit - emit.max(1, keepdims=True)).tolist()
    t00, t01, t10, t11 = np.exp(move - move.max()).ravel().tolist()
    a, b = np.exp(start - start.max()).tolist()
    ahead = []
    for k, (p0, p1) in enumerate(p):
        if k:
            a, b = a * t00 + b * t10, a * t01 + b * t11
        a, b = a * p0, b * p1
        a, b = a / (a + b), b / (a + b)
        ahead.append((a, b))
    moves = [0.0] * 4
    sure = [ahead[-1]]
    c, d = 1.0, 1.0  # sums over what follows
    for k in range(len(p) - 1, 0, -1):
        a, b = ahead[k - 1]
        e0, e1 = p[k][0] * c, p[k][1] * d
        x = (a * t00 * e0, a * t01 * e1, b * t10 * e0, b * t11 * e1)
        z = sum(x)
        moves = [m + y / z for m, y in zip(moves, x, strict=True)]
        sure.append(((x[0] + x[1]) / z, (x[2] + x[3]) / z))
        c, d = t00 * e0 + t01 * e1, t10 * e0 + t11 * e1
        c, d = c / (c + d), d / (c + d)
    return sure[::-1], moves


def train(pages: list[tuple[str, list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> FieldModel:
    """Maximum likelihood by AdaGrad over pages (html, label of each block), with a small L2 term."""
    index: dict[str, int] = {}
    data = []
    for page, labels in pages:
        bs = blocks(page)
        if len(bs) != len(labels):
            raise ValueError("a page's labels don't match its blocks")
        if bs:
            rows = [[index.setdefault(f, len(index)) for f in features(b, k, len(bs))] for k, b in enumerate(bs)]
            size = np.array([len(r) for r in rows])
            used, place = np.unique([f for r in rows for f in r], return_inverse=True)
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            data.append((used, place, size, np.eye(2)[labels], seen))
    w, move, start = np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2)
    gw, gm, gs = np.full_like(w, 1e-6), np.full_like(move, 1e-6), np.full_like(start, 1e-6)
    order = random.Random(5)
    for _ in range(epochs):
        order.shuffle(data)
        for used, place, size, want, seen in data:
            mine = w[used]
            sure, moves = _chain_sums(np.add.reduceat(mine[place], np.cumsum(size) - size), move, start)
            miss = want - np.array(sure)
            for x, total, grad in ((move, gm, seen - np.reshape(moves, (2, 2)) - decay * move), (start, gs, miss[0] - decay * start)):
                total += grad**2
                x += rate * grad / np.sqrt(total)
            each = np.repeat(miss, size, axis=0)
            grad = np.stack([np.bincount(place, each[:, y], len(used)) for y in range(2)], 1) - decay * mine
            gw[used] += grad**2
            w[used] = mine + rate * grad / np.sqrt(gw[used])
    return FieldModel({f: (float(w[k, 0]), float(w[k, 1])) for f, k in index.items()}, move.tolist(), start.tolist())


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page of a random layout with the label (1: article) of each of its leaf blocks. A quarter of the pages name nothing:
    menus and articles stand in the same plain elements, and only their text and links tell them apart."""
    r = random.Random(seed)
    labels: list[int] = []

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("aeinorstlu") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b)))

    def prose(a: int, b: int) -> str:
        text = words(a, b).capitalize()
        return text + r.choice([".", ".", ".", "!", "", "###", " ***"])

    def one(label: int, text: str) -> str:
        labels.append(label)
        return text

    def links(label: int, n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/{k}'>{one(label, words(1, 3))}</a></li>" for k in range(n)) + "</ul>"

    def box(names: list[str], tag: str = "div") -> tuple[str, str]:
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(names)}">', f"</{tag}>"

    def around(open_close: tuple[str, str], body: str) -> str:
        return open_close[0] + body + open_close[1]

    def paragraphs(label: int, a: int, b: int) -> str:
        out = []
        for _ in range(r.randint(a, b)):
            size = r.choice([(1, 3), (4, 20), (20, 120), (20, 120)])
            style = r.random()
            if style < 0.2:
                out.append(f"<p><b>{one(label, prose(*size))}<br>")
            elif style < 0.3:
                out.append(f"<p>{one(label, prose(*size) + '<br>' + prose(3, 30))}")
            else:
                out.append(f"<p>{one(label, prose(*size))}</p>")
        return "".join(out)

    def article() -> str:
        out = [f"<h1>{one(1, words(2, 12))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.4:
                out.append(f"<h2>{one(1, words(1, 7))}</h2>")
            out.append(paragraphs(1, 1, 6))
            extra = r.random()
            if extra < 0.12:
                out.append("<ul>" + "".join(f"<li>{one(1, prose(2, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif extra < 0.2:
                out.append(f"<blockquote>{one(1, prose(6, 40))}</blockquote>")
            elif extra < 0.26:
                out.append(f"<pre>{one(1, words(5, 40))}</pre>")
            elif extra < 0.34:
                out.append("<table>" + "".join(f"<tr><td>{one(1, words(1, 4))}</td><td>{one(1, words(1, 4))}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif extra < 0.42:
                out.append(advert())
        return "".join(out)

    def advert() -> str:
        return around(box(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner ad"]), r.choice([lambda: one(0, prose(3, 25)), lambda: paragraphs(0, 1, 2)])())

    def neutral() -> tuple[str, str]:
        """A wrap that says nothing of what is in it."""
        return r.choice([("<div>", "</div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>"), ("", "")])

    def plain_links(most: int) -> str:
        n, style = r.randint(2, most), r.random()
        if style < 0.4:
            return around(neutral(), links(0, n))
        if style < 0.7:  # one line
            return around(r.choice([("<p>", "</p>"), ("<center>", "</center>"), neutral()]), one(0, r.choice([" | ", " ", " - "]).join(f"<a href='/{k}'>{words(1, 3)}</a>" for k in range(n))))
        tag = r.choice(["p", "div", "dd", "td"])
        return around(neutral(), "".join(f"<{tag}><a href='/{k}'>{one(0, words(1, 3))}</a></{tag}>" for k in range(n)))

    def plain_article() -> str:
        tag, size = r.choice(["p", "div", "dd", "blockquote"]), r.choice([(4, 20), (20, 120), (20, 120)])
        head = f"<h{r.randint(1, 3)}>{one(1, words(2, 12))}</h1>" if r.random() < 0.8 else ""
        return head + "".join(f"<{tag}>{one(1, ' '.join(prose(*size) for _ in range(r.randint(1, 3))))}</{tag}>" for _ in range(r.randint(1, 8)))

    def plain_top() -> str:
        return plain_links(8) if r.random() < 0.9 else ""

    def plain_bottom() -> str:
        out = plain_links(6) if r.random() < 0.5 else ""
        owner = r.choice(["&copy; ", "(c) ", "Copyright "]) + str(r.randint(1990, 2030)) + " " + words(1, 4)
        return out + (around(r.choice([("<p>", "</p>"), ("<small>", "</small>"), ("<address>", "</address>"), neutral()]), one(0, owner)) if r.random() < 0.6 else "")

    def top() -> str:
        out = []
        if r.random() < 0.5:
            wrap = r.choice([("<header>", "</header>"), box(["header", "masthead", "site-header", "topbar"])])
            out.append(around(wrap, "".join(f"<{t}>{one(0, words(1, 6))}</{t}>" for t in r.choice([["div"], ["h1"], ["p", "p"], ["h2", "div"]]))))
        if r.random() < 0.9:
            wrap = r.choice([("<nav>", "</nav>"), ("<nav>", "</nav>"), box(["menu", "nav", "navbar", "main-menu", "breadcrumbs"])])
            out.append(around(wrap, links(0, r.randint(2, 8))))
        if r.random() < 0.35:
            out.append(around(box(["cookie", "cookie-notice", "notice", "consent", "alert", "banner"]), paragraphs(0, 1, 2)))
        if r.random() < 0.5:
            out.append("<!-- x -->" + advert())
        return "".join(out)

    def bottom() -> str:
        out = []
        if r.random() < 0.4:
            wrap = r.choice([("<aside>", "</aside>"), box(["sidebar", "related", "widget", "side", "share", "newsletter"])])
            out.append(around(wrap, r.choice([lambda: links(0, r.randint(2, 6)), lambda: paragraphs(0, 1, 4), lambda: f"<h3>{one(0, words(1, 3))}</h3>" + links(0, 3)])()))
        if r.random() < 0.3:
            out.append("<form><label>" + one(0, words(1, 4)) + "<input></label></form>")
        if r.random() < 0.45:
            wrap = r.choice([box(["comments", "comment-list", "responses", "discussion", "comment"], "section"), box(["comments", "comment", "replies", "disqus", "discussion"])])
            out.append(around(wrap, (f"<h3>{one(0, words(1, 3))}</h3>" if r.random() < 0.5 else "") + paragraphs(0, 1, 6)))
        if r.random() < 0.3:
            out.append(advert())
        if r.random() < 0.85:
            wrap = r.choice([("<footer>", "</footer>"), ("<footer>", "</footer>"), box(["footer", "site-footer", "copyright", "bottom"])])
            out.append(around(wrap, r.choice([lambda: one(0, "&copy; " + words(1, 4) + " &middot; " + prose(3, 12)), lambda: paragraphs(0, 1, 2) + links(0, 3)])()))
        return "".join(out)

    plain, bare = r.random() < 0.25, r.random() < 0.2
    head, tail = (plain_top, plain_bottom) if plain else (top, bottom)
    body = "" if bare and r.random() < 0.7 else head()
    wraps = [("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), box(["content", "post", "entry", "story", "article-body", "main-content"]), ("<div>", "</div>"), ("", "")]
    body += around(neutral(), r.choice([article, plain_article])()) if plain else around(r.choice(wraps), article())
    body += "" if bare and r.random() < 0.7 else tail()
    start = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>x</title><style>p{margin:0}</style></head><body>'
    return start + body + r.choice(["</body></html>", ""]), labels


#: Pages that the model is fitted on: a bound on the training sample.
TRAINING_PAGES = 500


@lru_cache(maxsize=2)
def default_model(pages: int = TRAINING_PAGES) -> FieldModel:
    return train([labelled_page(k) for k in range(pages)])


def main_text(page: str | None, model: FieldModel) -> str:
    """Article blocks of a page, joined by empty lines; empty for a null, empty or article-less page."""
    bs = blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(bs, model.label(bs), strict=True) if y)


def extract(pages: DataFrame, model: FieldModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages, in time in proportion to the page's length.

    Null and empty pages, and those without an article, have an empty text. Repeated rows and null ids stay, each with its
    own result; of labels equally probable, "not article" holds. Long pages are read whole; a page that ends within a
    tag ends before it. Other columns are left behind.
    """
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                out = [main_text(h.as_py(), model) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = pages.select("page_id", "url", F.col("html"))
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return widen(pages).mapInArrow(run, f"page_id {id_kind}, url {url_kind}, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, as extract defines it."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
