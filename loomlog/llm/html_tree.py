"""Main text of web pages by a tree-structured graphical model over block elements."""

from __future__ import annotations

import html
import random
import re
import uuid
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features of a block.
DIMENSIONS = 1 << 12
#: Characters of pages whose trees are solved together.
CHUNK_CHARS = 8_000_000
#: Labelled pages that the production model is trained from (built by ``labelled_pages``).
TRAIN_PAGES = 2_000

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never main text, to their end tag. Without one, the first of these run to the end of the page, by the standard.
RAW_TO_END = frozenset("script style textarea iframe".split())
RAW = RAW_TO_END | {"template", "svg"}
NEVER = frozenset("#head head title select option datalist dialog input".split())
INLINE = frozenset("a abbr acronym button label math b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr output meter progress picture map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("thead tbody tr td th", ("table",)), "body": ("head", ("html",))}
#: Elements that group others; the rest hold text. Which of the two a child is picks its potentials with its parent.
GROUPS = frozenset("#root html body article main section div header footer nav aside form ul ol dl table tbody thead tr figure details fieldset center hgroup".split())

#: What begins with "<": a comment, a declaration or the like, or a tag up to the end of its name.
_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<other>[!?]|/(?![a-zA-Z]))|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+))")
_ATTRIBUTES = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+(?=>)")
_NAMED = re.compile(r"(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_MAIN = re.compile(r"data-main=\"([01])\"")
_PIECES = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Block elements in page order (the first one is the root): parents, depths, features, groups; texts are (block, text)."""

    parents: list[int]
    depths: list[int]
    features: list[list[int]]
    groups: list[int]
    never: list[bool]
    texts: list[tuple[int, str]]
    labels: list[int]


def feature(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


_NAMES: dict[tuple[str, str], list[int]] = {}


def named_features(tag: str, attrs: str) -> list[int]:
    """Features of an element's name and of the words in its class, id, role and label."""
    key = (tag, attrs)
    if key not in _NAMES:
        if len(_NAMES) > 50_000:
            _NAMES.clear()
        words = {w for m in _NAMED.finditer(attrs) for w in _PIECES.findall((m[2] or m[3] or m[4] or "").lower())}
        _NAMES[key] = [feature(f"tag {tag}"), *(feature(f"word {w}") for w in sorted(words)), *([feature("named")] if words else [])]
    return _NAMES[key]


def tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name in lower case, whether it is an end tag, attributes) of each tag, and of each comment, declaration
    and raw element with the name "". A position is looked at a bounded number of times, however broken the page."""
    at, whole, ends = 0, True, {}
    while (m := _OPEN.search(source, at)) is not None:
        start = m.start()
        if m["tag"] is None:
            mark = "-->" if m["comment"] else ">"
            end = source.find(mark, m.end() - (2 if m["comment"] else 0))
            at = len(source) if end < 0 else end + len(mark)
            yield start, at, "", False, ""
            continue
        quoted = _ATTRIBUTES.match(source, m.end()) if whole else None
        # once quotes don't pair up to the end of the page, tags end at the next ">" whatever is quoted
        whole = whole and quoted is not None
        end = quoted.end() if quoted else source.find(">", m.end())
        if end < 0:  # an unfinished tag ends the page
            yield start, len(source), "", False, ""
            return
        tag, attrs, at = m["tag"].lower(), source[m.end() : end], end + 1
        if tag in RAW and not m["end"] and not attrs.endswith("/"):
            if tag not in ends:
                ends[tag] = re.compile(rf"</{tag}\s*+>", re.I)
            close = ends[tag] and ends[tag].search(source, at)
            if close:
                at = close.end()
            elif tag in RAW_TO_END:
                at = len(source)
            ends[tag] = ends[tag] if close else None  # no other end tag follows either
            yield start, at, "", False, ""
            continue
        yield start, at, tag, bool(m["end"]), attrs


def parse(source: str | None) -> Page:
    """The tree of block elements, by a forgiving reading: unclosed elements end where the standard implies it, stray end
    tags are skipped, scripts, styles, comments and other raw elements are dropped with what they hold."""
    page = Page([-1], [0], [[feature("tag #root")]], [0], [False], [], [int((source or "").startswith("\x01"))])
    # name and block of what is open; places in it of each name, of blocks, and of links
    stack, open_at = [("#root", 0)], defaultdict(list, {"#root": [0]})
    blocks, links = [0], []
    piece, chars, linked, within = [], [0], [0], [0]
    source = (source or "").removeprefix("\x01")  # a labelled page whose root is content starts with U+0001
    at = 0

    def flush() -> None:
        if piece:
            text = " ".join(html.unescape("".join(piece)).split())
            piece.clear()
            if text:
                page.texts.append((stack[-1][1], text))

    def text_in(raw: str) -> None:
        if raw:
            piece.append(raw)
            block, n = stack[-1][1], len(raw.strip())
            chars[block] += n
            linked[block] += n if links else 0

    def push(name: str, block: int) -> None:
        open_at[name].append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        if name == "a":
            links.append(len(stack))
        stack.append((name, block))

    def pop(until: int) -> None:
        while len(stack) > until:
            name, _ = stack.pop()
            open_at[name].pop()
            if name not in INLINE:
                blocks.pop()
            if name == "a":
                links.pop()

    for start, end, tag, closing, attrs in tags(source):
        text_in(source[at:start])
        at = end
        if not tag:
            continue
        if closing:
            if open_at[tag]:
                i = open_at[tag][-1]
                if tag in INLINE and blocks[-1] > i:
                    continue  # a block inside goes on
                if tag not in INLINE:
                    flush()
                pop(max(i, 1))
            elif tag in ("br", "p"):
                flush()
            continue
        if tag in INLINE:
            if tag == "a" and links and blocks[-1] < links[-1]:
                pop(links[-1])  # a link ends the one before
            if not attrs.endswith("/"):
                push(tag, stack[-1][1])
            continue
        flush()
        if tag in VOID or tag in RAW:
            continue
        if tag in CLOSES_P and open_at["p"]:
            pop(open_at["p"][-1])
        if tag in CLOSES:
            names, scope = CLOSES[tag][0].split(), CLOSES[tag][1]
            above = max((open_at[x][-1] for x in scope if open_at[x]), default=0)
            inside = [open_at[x][k] for x in names if (k := bisect_right(open_at[x], above)) < len(open_at[x])]
            if inside:
                pop(min(inside))
        above = stack[-1][1]
        block = len(page.parents)
        page.parents.append(above)
        page.depths.append(page.depths[above] + 1)
        page.features.append([*named_features(tag, attrs if "data-main" not in attrs else _MAIN.sub("", attrs)), _WITHIN[within[above]]])
        within.append(_SECTIONS.get(tag, within[above]))
        page.groups.append(0 if tag in GROUPS else 1)
        page.never.append(page.never[above] or tag in NEVER)
        told = _MAIN.search(attrs)
        page.labels.append(int(told[1]) if told else page.labels[above])
        chars.append(0)
        linked.append(0)
        push(tag, block)
    text_in(source[at:])
    flush()
    below, below_linked = [*chars], [*linked]
    for i in range(len(page.parents) - 1, 0, -1):
        below[page.parents[i]] += below[i]
        below_linked[page.parents[i]] += below_linked[i]
    signs = [0] * len(page.parents)
    for block, text in page.texts:
        signs[block] |= "©" in text
    for i in range(len(page.parents)):
        n = chars[i]
        page.features[i] = [
            *page.features[i],
            _LENGTH[min(n.bit_length(), 9)],
            _LINKED[0 if not n else 1 + (4 * linked[i] + n - 1) // n],
            _BELOW[min(below[i].bit_length(), 10)],
            _BELOW_LINKED[0 if not below[i] else 1 + (4 * below_linked[i] + below[i] - 1) // below[i]],
            _DEPTH[min(page.depths[i], 9)],
            *([_SIGN] if signs[i] else ()),
            *([_BARE] if n and not i else ()),
        ]
    return page


_SECTIONS = {name: i + 1 for i, name in enumerate("article main nav aside header footer form".split())}
_WITHIN = [feature(f"within {name}") for name in ("nothing", *_SECTIONS)]
_LENGTH = [feature(f"length {i}") for i in range(10)]
_LINKED = [feature(f"linked {i}") for i in range(6)]
_BELOW = [feature(f"below {i}") for i in range(11)]
_BELOW_LINKED = [feature(f"below linked {i}") for i in range(6)]
_DEPTH = [feature(f"depth {i}") for i in range(10)]
_SIGN = feature("copyright sign")
_BARE = feature("text outside of all elements")


@dataclass
class Model:
    """weights: each feature's score for content. potentials[g, parent's label, child's label]; g: whether the child groups."""

    weights: np.ndarray
    potentials: np.ndarray


class Forest:
    """Trees of many pages in flat arrays, levels in turn."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.parents) for p in pages]
        self.starts = np.cumsum([0, *sizes])
        n = int(self.starts[-1])
        shift = np.repeat(self.starts[:-1], sizes)
        self.parents = np.fromiter((x for p in pages for x in p.parents), np.int64, n) + shift
        self.depths = np.fromiter((x for p in pages for x in p.depths), np.int64, n)
        self.groups = np.fromiter((x for p in pages for x in p.groups), np.int64, n)
        self.never = np.fromiter((x for p in pages for x in p.never), bool, n)
        counts = np.fromiter((len(f) for p in pages for f in p.features), np.int64, n)
        self.flat = np.fromiter((x for p in pages for f in p.features for x in f), np.int64, int(counts.sum()))
        self.owner = np.repeat(np.arange(n), counts)
        order = np.argsort(self.depths, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depths[order]))[:-1]) if n else []

    def solve(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Content marginals of all blocks, by messages up to the roots and down again; then each child's joint marginal
        with its parent's label (n x 2 x 2, by parent's and child's label)."""
        n = len(self.parents)
        local = np.zeros((n, 2))
        local[:, 1] = np.bincount(self.owner, model.weights[self.flat], n)
        local[self.never, 1] = -40.0
        edges = model.potentials[self.groups]  # n x 2 x 2
        inside, up = local.copy(), np.zeros((n, 2))
        for level in reversed(self.levels[1:]):
            up[level] = np.logaddexp(edges[level, :, 0] + inside[level, None, 0], edges[level, :, 1] + inside[level, None, 1])
            up[level] -= up[level].max(1, keepdims=True)
            np.add.at(inside, self.parents[level], up[level])
        outside, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = self.parents[level]
            rest = inside[above] + outside[above] - up[level]
            both = edges[level] + rest[:, :, None]
            outside[level] = np.logaddexp(both[:, 0], both[:, 1])
            outside[level] -= outside[level].max(1, keepdims=True)
            both = both + inside[level][:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            joint[level] = both / both.sum((1, 2), keepdims=True)
        belief = inside + outside
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint, local


def train(sources: list[str], epochs: int = 30, batch: int = 60, rate: float = 0.3, penalty: float = 2e-4) -> Model:
    """Fit weights and potentials to pages whose elements carry data-main="1" or "0" (it holds for what they contain; the
    default is 0), by ascending the labels' conditional likelihood; the messages' marginals give the exact gradient."""
    pages = [parse(s) for s in sources]
    model = Model(np.zeros(DIMENSIONS), np.zeros((2, 2, 2)))
    sums = [np.full(DIMENSIONS, 1e-8), np.full((2, 2, 2), 1e-8)]
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(pages)), max(1, len(pages) // batch)):
            chosen = [pages[i] for i in some]
            forest = Forest(chosen)
            gold = np.fromiter((x for p in chosen for x in p.labels), np.int64, len(forest.parents)) * ~forest.never
            marginal, joint, _ = forest.solve(model)
            gap = np.where(forest.never, 0, gold - marginal)
            told = np.zeros_like(joint)
            child = forest.depths > 0
            told[child, gold[forest.parents[child]], gold[child]] = 1
            slopes = [np.bincount(forest.flat, gap[forest.owner], DIMENSIONS) - penalty * len(some) * model.weights, np.stack([(told - joint)[child & (forest.groups == g)].sum(0) for g in (0, 1)])]
            for x, total, slope in zip((model.weights, model.potentials), sums, slopes, strict=True):
                total += slope**2
                x += rate * slope / np.sqrt(total)
    return model


def extract(model: Model, sources: list[str | None]) -> list[str]:
    """Texts of blocks that are more likely content than not, in page order, joined by one space."""
    out: list[str] = []
    held: list[Page] = []
    size = 0

    def solve() -> None:
        forest = Forest(held)
        marginal = forest.solve(model)[0]
        for page, start in zip(held, forest.starts, strict=False):
            out.append(" ".join(text for block, text in page.texts if marginal[start + block] > 0.5))

    for source in sources:
        held.append(parse(source))
        size += len(source or "")
        if size >= CHUNK_CHARS:
            solve()
            held, size = [], 0
    if held:
        solve()
    return out


_MODELS: dict[str, Model] = {}


def main_text(pages: DataFrame, model: Model | None = None, source: str = "html") -> Column:
    """The main text of each page ("" if it has none; null and empty pages have none).

    The model (16 K weights at most) is all that is shipped; each page is read as a whole. Without a model, one is trained
    from the built-in labelled pages.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages(TRAIN_PAGES)))
    key = uuid.uuid4().hex

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if key not in _MODELS:
                _MODELS.clear()
                _MODELS[key] = shipped.value
            yield pa.array(extract(_MODELS[key], batch.to_pylist()), pa.string())

    return run(F.col(source))


def extract_main_text(pages: DataFrame, model: Model | None = None, source: str = "html", name: str = "text") -> DataFrame:
    """Add the main text as column ``name`` and its code points as ``n_chars``; columns of these names are replaced.

    Repeated pages are read as often as they occur; an empty table gives no rows.
    """
    return pages.withColumn(name, main_text(pages, model, source)).withColumn("n_chars", F.char_length(name).cast("long"))


_NO_STOPS = str.maketrans("", "", ".,!?")

# Labelled pages ------------------------------------------------------------------------------------------------------

_MENU = "nav menu navbar navigation breadcrumbs toolbar tabs pager pagination toc topbar".split()
_TOP = "header masthead banner branding top logo hero tagline site-header page-header".split()
_BOTTOM = "footer site-footer bottom copyright colophon legal page-footer credits imprint".split()
_SIDE = "sidebar side aside widget related recommended trending popular promo teaser rail more-stories see-also".split()
_ADVERT = "ad ads advert advertisement sponsored sponsor ad-slot banner-ad promo commercial adsbygoogle".split()
_NOTICE = "notice cookie cookie-notice consent gdpr alert warning popup modal paywall subscribe newsletter disclaimer message overlay".split()
_REPLIES = "comments comment-list responses discussion replies respond thread disqus reviews".split()
_REPLY = "comment reply response review comment-body media".split()
_SHARE = "share social meta byline tags tools print follow author-box".split()
_CONTENT = "content post entry article story main body text post-content entry-content article-body page-content main-content".split()


def labelled_pages(count: int, seed: int = 3) -> list[str]:
    """Pages put together from the usual parts, at random, with what is content marked by data-main."""
    r, stops = random.Random(seed), True

    def sentence(low: int, high: int) -> str:
        words = ["".join(r.choice(("ba", "ke", "lo", "mir", "sta", "the", "on", "é")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(w + ("," if r.random() < 0.08 else "") for w in words).capitalize() + r.choice((".", ".", ".", "", "!", "?"))

    def text(low: int, high: int) -> str:
        out = " ".join(sentence(1, 14) for _ in range(r.randint(low, high)))
        return out if stops else out.translate(_NO_STOPS)

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/x">{sentence(low, high)}</a>'

    def named(words: list[str]) -> str:
        return f' {r.choice(("class", "class", "id"))}="{r.choice(words)}"'

    def boxed(tags: str, words: list[str], inner: str, always: float = 0.5) -> str:
        """An element known by its tag, its name, or both."""
        tag = r.choice(tags.split()) if r.random() < always or not words else "div"
        name = named(words) if words and (tag == "div" or r.random() < 0.4) else ""
        return f'<{tag}{name} data-main="0">{inner}</{tag}>'

    def links() -> str:
        items = [link() for _ in range(r.randint(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " | ".join(items)

    def prose(low: int = 1, high: int = 4) -> str:
        inner = text(low, high)
        return r.choice((f"<p>{inner}</p>", f"<p>{inner}</p>", f"<p>{inner}", f"<p><b>{inner}<br>", f"<div>{inner}</div>", inner))

    def reply() -> str:
        tag = r.choice(("div", "article", "li", "section"))
        inner = (f"<h4>{sentence(1, 2)}</h4>" if r.random() < 0.5 else f"<span>{sentence(1, 2)}</span> ") + "".join(f"<p>{text(1, 4)}</p>" for _ in range(r.randint(1, 2)))
        return f"<{tag}{named(_REPLY) if r.random() < 0.7 else ''}>{inner}</{tag}>"

    def extra() -> str:
        kind = r.randrange(6)
        if kind == 0:
            return boxed("aside", _SIDE, r.choice((links(), prose(), f"<h3>{sentence(1, 4)}</h3>{links()}", f"<h3>{sentence(1, 3)}</h3><p>{text(1, 3)}</p>")))
        if kind == 1:
            return boxed("div ins section", _ADVERT, prose(1, 3), 0.0)
        if kind == 2:
            return boxed("form", [], r.choice(("", f"<p>{sentence(2, 9)}</p>")) + f"<label>{sentence(1, 2)}</label><input name=q><button>{sentence(1, 2)}</button>", 1.0)
        if kind == 3:
            return boxed("div section", _NOTICE, prose(1, 2), 0.0)
        if kind == 4:
            return boxed("div p ul", _SHARE, links(), 0.0)
        return boxed("section", _REPLIES, r.choice(("", f"<h2>{sentence(1, 2)}</h2>", f"<h3>{sentence(1, 2)}</h3>")) + "".join(reply() for _ in range(r.randint(1, 4))), 0.0)

    def content() -> str:
        parts = [f"<{h}>{sentence(1, 10)}</{h}>" for h in [r.choice(("h1", "h1", "h2"))] if r.random() < 0.85]
        if r.random() < 0.25:
            parts = [f"<header>{''.join(parts)}</header>"]
        short = r.random() < 0.25
        for _ in range(r.choice((0, 1, 1, 2, 3, 5, 8, 12, 25)) if parts else r.choice((1, 2, 3, 8))):
            kind = r.random()
            if kind < 0.72:
                body = sentence(1, 3) if short and r.random() < 0.9 else text(1, r.choice((1, 2, 4, 9, 30)))
                body = body if r.random() < 0.8 else f"{body} {link()} {text(1, 2)}"
                parts.append(r.choice((f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}</p>", f"<p>{body}", f"<p><b>{body}<br>", f"<p><em>{body}</em></p>")))
            elif kind < 0.8:
                parts.append(f"<h2>{sentence(1, 6)}</h2>")
            elif kind < 0.86:
                parts.append(r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{text(1, 2)}</li>" for _ in range(r.randint(2, 5)))))
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{text(1, 3)}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{text(1, 3)}</blockquote>")
            elif kind < 0.93:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{sentence(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.95:
                parts.append(f"<pre>{text(1, 4)}</pre>")
            elif kind < 0.97:
                parts.append(f"<figure><img src=x><figcaption>{sentence(2, 9)}</figcaption></figure>")
            else:
                parts.append(f"<section><h3>{sentence(1, 4)}</h3><p>{text(1, 4)}</p></section>")
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            parts.insert(r.randrange(len(parts) + 1), extra())
        inner = "".join(parts)
        tag, name = r.choice((("article", ""), ("article", ""), ("article", named(_CONTENT)), ("main", ""), ("main", ""), ("div", named(_CONTENT)), ("div", named(_CONTENT)), ("section", named(_CONTENT)), ("div", "")))
        inner = f'<{tag}{name} data-main="1">{inner}</{tag}>'
        return r.choice((inner, inner, inner, f'<main data-main="1">{inner}</main>', f'<div class="{r.choice(("container", "wrapper", "row", "page", "layout"))}">{inner}</div>', f"<div>{inner}</div>"))

    def page() -> str:
        nonlocal stops
        parts = []
        stops = r.random() < 0.8
        if r.random() < 0.6:
            parts.append(boxed("header", _TOP, r.choice((f"<h1>{sentence(1, 3)}</h1>", f"<h1>{link()}</h1>", f"<h1>{sentence(1, 2)}</h1><p>{sentence(1, 5)}</p>", f"<h2>{sentence(1, 3)}</h2><p>{sentence(1, 8)}</p>", link(), f"{links()}", f"<p>{sentence(1, 8)}</p>"))))
        if r.random() < 0.75:
            parts.append(boxed("nav", _MENU, links(), 0.6))
        parts += [extra() for _ in range(r.choice((0, 0, 1, 1, 2)))]
        parts.append(content())
        parts += [extra() for _ in range(r.choice((0, 0, 1, 1, 2, 3)))]
        if r.random() < 0.8:
            parts.append(boxed("footer", _BOTTOM, r.choice((f"&copy; {text(1, 2)}", f"<p>&copy; {sentence(1, 9)}</p>", links(), f"<p>{text(1, 2)}</p>{links()}", f"&copy; x &middot; {text(1, 2)}"))))
        body = "".join(parts)
        if r.random() < 0.08:  # fragments of pages
            return "\x01" + r.choice((text(1, 6), "".join(prose(1, 5) for _ in range(r.randint(1, 5))), f"<html><body>{prose(1, 5)}{prose(1, 5)}</body></html>"))
        return f"<!DOCTYPE html><html><head><title>{sentence(1, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"

    return [page() for _ in range(count)]
