"""Main text of web pages by equivalence classes of tokens over the pages of a host.

A token is an element, named by its path of tags, classes and ids, or a block of
text at such a path. The outermost elements of a page are its layout; pages of one
host and layout share a template. Tokens whose occurrence vectors over those pages
are equal form a class: one sum of hashed (page, count) pairs stands for the
vector, so classes come from plain aggregations that combine before the shuffle.
Classes that nearly every page has, with a fixed count, are valid; they nest by
the paths of their elements and make up the template. What the template
leaves open are its slots. The main slot is the template element that holds the
article; its blocks are the page's text, without blocks whose elements have
another purpose and without template texts. Layouts with few pages have no
template; their pages are cut by their own elements in the same way.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.llm.common import byte_slices, free_name, with_fields
from strainframe.session import cut_lineage

#: Pages that a layout needs for a template, and the share of its pages that a valid class is found on.
LEAST_PAGES = 4
#: Pages that a template text inside a marked article needs: few articles may share a heading by chance.
LEAST_ARTICLES = 10
#: Elements down to this depth (0: the page, 2: its body) make up a layout.
LAYOUT_DEPTH = 3
SUPPORT = 0.9
#: Template texts inside the main slot are dropped if they are at most this share of it (else the pages are copies).
TEMPLATE_SHARE = 0.3
#: A container is the main slot if it holds this share of the text that has no other purpose.
MAIN_SHARE = 0.8
#: Template rows (host, token) that are broadcast to the pages; larger templates are joined by a shuffle.
BROADCAST_ROWS = 500_000

# Elements and names with another purpose than the article.
OTHER_TAGS = frozenset([
    "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "button", "select",
    "textarea", "head", "dialog", "menu", "object", "canvas", "audio", "video",
])
OTHER_ROLES = frozenset([
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog",
    "menu", "menubar", "toolbar",
])
OTHER_WORDS = frozenset([
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "comment", "comments", "respond", "disqus",
    "share", "sharing", "social", "related", "newsletter", "subscribe", "subscription", "login", "signup",
    "pagination", "pager", "copyright", "breadcrumb", "breadcrumbs", "responses", "replies",
])
#: Whole names of an article's own container; beside them only whole names speak for another purpose.
ARTICLE_NAMES = frozenset([
    "article", "article-body", "articlebody", "content", "main", "main-content", "post", "post-content", "entry", "entry-content",
    "story", "story-body",
])
#: Names that a layout around an article may also have.
LAYOUT_WORDS = frozenset([
    "sidebar", "side", "nav", "navbar", "navigation", "menu", "header", "footer", "banner", "widget", "toolbar",
])
INLINE_TAGS = frozenset([
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
])
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
])
RAW_TAGS = frozenset([
    "script", "style", "textarea", "title", "noscript", "iframe",
])
#: Opening one of the first ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_ENDERS = frozenset([
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
])
P_WALLS = frozenset([
    "article", "aside", "body", "button", "caption", "div", "dd", "dt", "fieldset", "figure", "footer", "form",
    "header", "html", "li", "main", "nav", "section", "td", "th",
])

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
#: A name with its value; values are passed over whole, so that no name is read out of them or out of a longer name.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_READ = frozenset(["class", "id", "role", "itemprop", "hidden"])
_NAME_WORD = re.compile(r"[a-z]+")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in sorted(RAW_TAGS)}


#: What a template belongs to.
TEMPLATE = ["host", "layout"]


class Element:
    __slots__ = ("article", "chars", "depth", "inside", "landmark", "other", "parent", "soft", "tag", "token")

    def __init__(self, tag: str, parent: Element | None, names: dict[str, str]):
        self.tag, self.parent, self.chars = tag, parent, 0
        whole = tag in ("html", "body")
        tokens = re.sub(r"\d+", "", f"{names.get('class', '')} {names.get('id', '')}").lower().split() if names else []
        # The names of the whole page tell about this page, not about its place in the layout.
        named = "" if whole else " ".join(sorted(tokens))
        self.token = xxhash.xxh64_intdigest(f"{parent.token if parent else 0} {tag} {named}") >> 1
        self.depth = parent.depth + 1 if parent else 0
        words, role = set(_NAME_WORD.findall(named)) if named else set(), names.get("role", "").lower()
        main = tag in ("article", "main") or role in ("main", "article") or names.get("itemprop", "").lower() == "articlebody"
        self.landmark = (2 if tag == "article" or main and tag != "main" and role != "main" else 1) if main else 0
        #: Whether it is a landmark or inside one, and the same for articles.
        self.inside = bool(self.landmark or parent and parent.inside)
        self.article = bool(self.landmark == 2 or parent and parent.article)
        # The article itself may be named after its subject: only whole names count on it.
        subject = (main or not ARTICLE_NAMES.isdisjoint(tokens)) and not (parent and parent.article)
        foreign = not OTHER_WORDS.isdisjoint(tokens if subject else words)
        own = tag in OTHER_TAGS or role in OTHER_ROLES or "hidden" in names or not whole and foreign
        soft = not whole and not main and bool(words & LAYOUT_WORDS) or tag == "header"
        if parent and parent.inside and (tag == "header" or words & LAYOUT_WORDS == {"header"}):
            soft = False  # the head of the article itself
        self.other = own or bool(parent and parent.other)
        # A landmark inside a layout element counts again; one inside an advert or a comment does not.
        self.soft = soft or bool(parent and parent.soft and not main)

    @property
    def apart(self) -> bool:
        return self.other or self.soft


class Deep:
    """An element below the layout, of which only the place on the stack counts."""

    __slots__ = ("depth", "tag")

    def __init__(self, tag: str, depth: int):
        self.tag, self.depth = tag, depth


class Page:
    """Elements and text blocks of a page, read leniently as browsers do; an ``outline`` has the elements of its layout only."""

    def __init__(self, source: str, outline: bool = False):
        self._outline = outline
        self.elements: list[Element] = []
        self.blocks: list[tuple[Element, str]] = []
        self._run: list[str] = []
        root = self._open("#page", None, {})
        stack, at, size = [root], 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            self._text(stack[-1], source[at : found.start() if found else size])
            if not found:
                break
            at = found.end()
            closing, name, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            tag = name.lower()
            if tag not in INLINE_TAGS:
                self._flush(stack[-1])
            if closing:
                for place in range(len(stack) - 1, 0, -1):
                    if stack[place].tag == tag:
                        self._flush_inline(stack[place])
                        del stack[place:]
                        break
                continue
            self._end_implied(stack, tag)
            if tag in VOID_TAGS:
                continue
            if outline and stack[-1].depth >= LAYOUT_DEPTH:
                at = self._enter(stack, Deep(tag, stack[-1].depth + 1), source, at, rest)
                continue
            names = {}
            for key, *values in _ATTRIBUTE.findall(rest) if rest else ():
                if key.lower() in _READ:
                    names.setdefault(key.lower(), next((x for x in values if x), ""))
            inline = tag in INLINE_TAGS
            element = Element(tag, stack[-1], names)
            if inline and not element.apart:
                element.token = stack[-1].token  # inline marks do not cut a block
            elif inline:
                self._flush(stack[-1])
            if not inline:
                self.elements.append(element)
            at = self._enter(stack, element, source, at, rest)
        self._flush(stack[-1])
        for element, text in self.blocks:
            while element is not None:
                element.chars += len(text)
                element = element.parent

    def _enter(self, stack: list, element: Element | Deep, source: str, at: int, rest: str) -> int:
        """Put the element on the stack, or pass over the raw text that it holds; the place to read on from."""
        tag = element.tag
        if tag in RAW_TAGS:
            end = _RAW_ENDS[tag].search(source, at)
            return end.end() if end else len(source)
        if not rest.rstrip().endswith("/") or tag not in ("path", "use"):
            stack.append(element)
        return at

    def _open(self, tag, parent, names) -> Element:
        element = Element(tag, parent, names)
        self.elements.append(element)
        return element

    def _end_implied(self, stack: list[Element], tag: str) -> None:
        if tag in P_ENDERS:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag == "p":
                    del stack[place:]
                    break
                if stack[place].tag in P_WALLS:
                    break
        ended = ENDS.get(tag)
        if ended:
            for place in range(len(stack) - 1, 0, -1):
                if stack[place].tag in ended:
                    del stack[place:]
                    break
                if stack[place].tag in ("ul", "ol", "dl", "table", "select"):
                    break

    def _text(self, element: Element, text: str) -> None:
        if text and not self._outline:
            self._run.append(html.unescape(text) if "&" in text else text)
            if element.apart and element.tag in INLINE_TAGS:
                self._flush(element)

    def _flush_inline(self, element: Element) -> None:
        if not self._outline and element.apart and element.tag in INLINE_TAGS:
            self._flush(element)

    def _flush(self, element: Element) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            self._run = []
            if text and not element.apart:
                while element.tag in INLINE_TAGS and element.parent is not None:
                    element = element.parent
                self.blocks.append((element, text))

    def layout(self) -> int:
        """The outermost elements that may hold text of the article, whatever their number and order."""
        outer = {x.token for x in self.elements if x.depth <= LAYOUT_DEPTH and not x.apart and x.tag not in RAW_TAGS}
        return xxhash.xxh64_intdigest(",".join(map(str, sorted(outer)))) >> 1

    def text_token(self, element: Element, text: str) -> int:
        return xxhash.xxh64_intdigest(f"{element.token} {text}") >> 1

    def main_token(self) -> int:
        """The page's own choice: its longest article, else its longest main part, else the smallest element with most of the text."""
        total = self.elements[0].chars
        for rank in (2, 1):
            marked = [x for x in self.elements if x.landmark == rank and not x.apart and x.chars]
            if marked:
                return max(marked, key=lambda x: (x.chars, -x.depth)).token
        large = [x for x in self.elements if not x.apart and x.chars >= MAIN_SHARE * total]
        return max(large, key=lambda x: x.depth).token if large else self.elements[0].token

    def text(self, mains: list[int], texts: frozenset) -> str:
        """Blocks inside the first of the containers that the page has, without the template's texts."""
        own = {x.token for x in self.elements if x.chars}
        main = next((token for token in mains if token in own), None)
        if main is None:
            main = self.main_token()
        kept = []
        for element, text in self.blocks:
            up = element
            while up is not None and up.token != main:
                up = up.parent
            if up is not None and not (texts and self.text_token(element, text) in texts):
                kept.append(text)
        return " ".join(kept)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "layout", "page", "token", "parent", "is_text", "n", "chars", "rank", "depth"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    for batch in batches:
        for first, sources in byte_slices(batch, 1, 1 << 20):
            hosts = batch.column(0).slice(first, len(sources)).to_pylist()
            rows = []
            for host, source in zip(hosts, sources, strict=True):
                page = Page((source or b"").decode())
                layout, key = page.layout(), xxhash.xxh64_intdigest(source or b"") >> 1
                found: dict[int, list] = {}
                for x in page.elements:
                    if x.parent is None or x.chars and not x.apart:
                        row = found.setdefault(x.token, [x.parent.token if x.parent else 0, False, 0, 0, x.landmark, x.depth])
                        row[2] += 1
                        row[3] += x.chars
                for x, text in page.blocks:
                    row = found.setdefault(page.text_token(x, text), [x.token, True, 0, 0, int(x.article), x.depth + 1])
                    row[2] += 1
                    row[3] += len(text)
                rows += [(host, layout, key, token, *row) for token, row in found.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def page_tokens(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    picked = pages.select(host_of(F.col(url_column)).alias("host"), F.col(html_column).cast("string").alias("html"))
    schema = "host string, layout long, page long, token long, parent long, is_text boolean, n int, chars long, rank int, depth int"
    return picked.mapInArrow(_token_batches, schema)


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """(host, layout, token, parent, is_text, chars, rank, depth, pages, each, class): tokens of valid classes.

    ``class`` is the hash of the occurrence vector, equal for the tokens of a class;
    ``each`` is the fixed count on a page. The class around it is that of ``parent``.
    ``rank`` tells landmarks among elements, and texts inside articles.
    """
    mark = F.xxhash64("page", "n")
    low, high = mark.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(mark, 32)
    vectors = tokens.groupBy(*TEMPLATE, "token").agg(
        F.count("*").alias("pages"),
        F.sum("n").alias("total"),
        F.max("n").alias("each"),
        F.min("n").alias("least"),
        F.sum(low).alias("low"),
        F.sum(high).alias("high"),
        F.sum("chars").alias("chars"),
        F.max("parent").alias("parent"),
        F.max("is_text").alias("is_text"),
        F.max("rank").alias("rank"),
        F.max("depth").alias("depth"),
    )
    frequent = cut_lineage(vectors.filter((F.col("pages") >= LEAST_PAGES) & (F.col("each") == F.col("least"))))
    # Every page has its outermost element, at depth 0.
    counts = frequent.filter("depth = 0").select(*TEMPLATE, F.col("pages").alias("of"))
    valid = frequent.join(counts, TEMPLATE).filter(F.col("pages") >= SUPPORT * F.col("of"))
    return valid.withColumn("class", F.xxhash64("pages", "total", "low", "high"))


def templates(classes: DataFrame) -> DataFrame:
    """(host, layout, mains, texts): containers of the main slot in order of preference, and template texts to leave out.

    A template holds at most a page's tokens a few times over, so a layout's row is
    bounded. Texts stay where they make up much of the main slot: the pages are copies then.
    """
    # A text is part of the template only together with an element of its class.
    with_elements = classes.filter("not is_text").select(*TEMPLATE, "class").distinct()
    texts = classes.filter(F.col("is_text") & ((F.col("rank") == 0) | (F.col("pages") >= LEAST_ARTICLES)))
    texts = texts.join(with_elements, [*TEMPLATE, "class"], "left_semi")
    bodies = classes.filter("not is_text and each = 1")
    wide = bodies.groupBy(*TEMPLATE).agg(F.max("chars").alias("most"))
    eligible = bodies.join(wide, TEMPLATE).filter((F.col("rank") > 0) | (F.col("chars") >= MAIN_SHARE * F.col("most")))
    order = F.struct((-F.col("rank")).alias("a"), F.when(F.col("rank") > 0, -F.col("chars")).otherwise(0).alias("b"), (-F.col("depth")).alias("c"), "token")
    mains = eligible.groupBy(*TEMPLATE).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["token"]).alias("mains"), F.max("most").alias("most"))
    left_out = texts.groupBy(*TEMPLATE).agg(F.collect_list("token").alias("texts"), F.sum("chars").alias("fixed"))
    met = mains.join(left_out, TEMPLATE, "left")
    return met.select(*TEMPLATE, "mains", F.when(F.col("fixed") <= TEMPLATE_SHARE * F.col("most"), F.col("texts")).alias("texts"))


def _layout_batches(batches: Iterator[pa.RecordBatch], source: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sources in byte_slices(batch, source, 4 << 20):
            part = batch.slice(first, len(sources))
            found = [Page((plain or b"").decode(), outline=True).layout() for plain in sources]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], names=[*part.schema.names, name])


def _text_batches(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[pa.RecordBatch]:
    source, mains, texts = columns
    for batch in batches:
        for first, sources in byte_slices(batch, source, 4 << 20):
            part = batch.slice(first, len(sources))
            sets: dict[tuple, frozenset] = {}
            found = []
            for plain, main, fixed in zip(sources, part.column(mains).to_pylist(), part.column(texts).to_pylist(), strict=True):
                fixed = tuple(fixed or ())
                found.append(Page((plain or b"").decode()).text(main or [], sets.setdefault(fixed, frozenset(fixed))))
            kept = [n for n in range(part.num_columns) if n not in (source, mains, texts)]
            arrays = [part.column(n) for n in kept] + [pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[part.schema.names[n] for n in kept] + ["main_text"])


def main_text(pages: DataFrame, url_column: str = "url", html_column: str = "html", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pages with ``main_text`` in place of their html.

    Null html counts as empty and gives an empty text; pages whose URL is null or has
    no host count as one host. Repeated rows are pages of their own. A column named
    ``main_text`` is replaced, all others stay.
    """
    from pyspark.sql.types import StructType

    pages = pages.drop(*[name for name in pages.columns if name.lower() == "main_text"])
    found = cut_lineage(templates(cut_lineage(equivalence_classes(page_tokens(pages, url_column, html_column)))))
    size = found.agg(F.coalesce(F.sum(F.size("mains") + F.coalesce(F.size("texts"), F.lit(0))), F.lit(0))).first()[0]
    layout, host, own, mains, texts = (free_name(pages, name) for name in ("layout", "template_host", "template_layout", "main_tokens", "fixed_texts"))
    found = found.select(F.col("host").alias(host), F.col("layout").alias(own), F.col("mains").alias(mains), F.col("texts").alias(texts))
    side = F.broadcast(found) if size <= broadcast_rows else found
    laid = pages.withColumn(html_column, F.col(html_column).cast("string"))
    step = partial(_layout_batches, source=laid.columns.index(html_column), name=layout)
    laid = laid.mapInArrow(step, with_fields(laid, f"{layout} long"))
    met = laid.join(side, (host_of(F.col(url_column)) == F.col(host)) & (F.col(layout) == F.col(own)), "left").drop(layout, host, own)
    columns = [met.columns.index(name) for name in (html_column, mains, texts)]
    kept = [field for n, field in enumerate(met.schema.fields) if n not in columns]
    schema = StructType(kept).add("main_text", "string")
    return met.mapInArrow(partial(_text_batches, columns=columns), schema)
