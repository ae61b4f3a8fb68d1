"""Selectors over page trees, an Arrow batch at a time: article bodies by host, rows of list pages.

Pages are read leniently: void elements have no inside, an end tag closes what it can, a paragraph ends
where the next block begins, and what is still open ends with the page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

# Hosts whose articles are known, their selectors in order, and what goes from within them.
_PLAIN = ("script", "style", "iframe", "figure")
ARTICLE_RULES = (
    ("yna.co.kr", (".story-news.article p", "article p", "article"), (*_PLAIN, "aside", ".adrs", ".adv", ".btn")),
    ("daum.net", (".article_view p", ".article_view"), (*_PLAIN, "figcaption", ".link_figure", ".txt_caption")),
    ("nate.com", ("#realArtcContents",), ("script", "style", "iframe", ".articleSubecjt", ".articleControl")),
    ("joongang.co.kr", ("#article_body p", "#article_body", ".article_body p"), (*_PLAIN, "figcaption", ".ab_photo", ".image")),
    ("kbs.co.kr", (".detail-body", "#cont_newstext"), (*_PLAIN, "figcaption", ".reporter", ".related")),
    ("ytn.co.kr", ("#CmAdContent", ".article_txt"), (*_PLAIN, "figcaption", ".reporter_area", ".link_news")),
    ("imbc.com", (".news_txt", ".content_body"), (*_PLAIN, "figcaption", ".img_set", ".ad")),
    ("zum.com", ("article",), (*_PLAIN, "figcaption", ".link_news", ".linkNews", ".relatedNews", ".ad", "ins")),
)
#: For hosts without a rule, if asked for.
ANY_HOST = (("article p", "article", "main p", "main", "body p", "body"), ("script", "style"))
LEAST_BODY, MOST_BODY, LEAST_PARAGRAPH = 100, 4000, 10

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("p div ul ol table section article main header footer form h1 h2 h3 h4 h5 h6 blockquote figure aside pre".split())
_ALONE = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_HOLDS = {"li": ("ul", "ol"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attributes", "classes", "inside", "parent", "tag")

    def __init__(self, tag: str, attributes: dict, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.classes = frozenset((attributes.get("class") or "").split())
        self.inside: list = []

    def walk(self):
        """All elements within, in the page's order; no recursion, as pages may nest deeply."""
        left = [x for x in reversed(self.inside) if isinstance(x, Node)]
        while left:
            node = left.pop()
            yield node
            left += [x for x in reversed(node.inside) if isinstance(x, Node)]

    def text(self, without: tuple = ()) -> str:
        """The text within, but for elements that one of the selectors ``without`` fits."""
        out, left = [], list(reversed(self.inside))
        while left:
            x = left.pop()
            if isinstance(x, str):
                out.append(x)
            elif not any(fits(x, s) for s in without):
                left += reversed(x.inside)
        return "".join(out)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._close("p", ("table", "td", "th", "li", "button"))
        for other in _ALONE.get(tag, ()):
            self._close(other, _HOLDS[tag])
        node = Node(tag, dict(attrs), self.at)
        self.at.inside.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(tag, ())

    def handle_endtag(self, tag):
        self._close(tag, ())

    def handle_data(self, data):
        self.at.inside.append(data)

    def _close(self, tag: str, within: tuple) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in within:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent


def tree(html: str | None) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


_PART = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[*^$]?=\"?[^\]\"]*\"?)?\])*)$")
_TEST = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:([*^$]?)=\"?([^\]\"]*)\"?)?\]")
_parts: dict = {}


def _compound(part: str) -> tuple:
    """(tag, [(kind, name, value)]) of one part of a selector."""
    if part not in _parts:
        m = _PART.match(part)
        if not m or not part:
            raise ValueError(f"selector {part!r} isn't understood")
        tests = [(t[1] or f"[{t[4] or ''}", t[2] or t[3], t[5]) for t in _TEST.finditer(m[2])]
        _parts[part] = (None if m[1] in (None, "*") else m[1].lower(), tests)
    return _parts[part]


def fits(node: Node, part: str) -> bool:
    """Whether ``tag.class#id[attribute*="value"]`` fits."""
    tag, tests = _compound(part)
    if tag is not None and node.tag != tag:
        return False
    for kind, name, value in tests:
        if kind == ".":
            ok = name in node.classes
        elif kind == "#":
            ok = node.attributes.get("id") == name
        else:
            has = node.attributes.get(name)
            ok = name in node.attributes if value is None else has is not None and {"[": has == value, "[*": value in has, "[^": has.startswith(value), "[$": has.endswith(value)}[kind]
        if not ok:
            return False
    return True


def select(root: Node, selector: str):
    """Elements below ``root`` that the selector fits, in order: parts apart by spaces (within) or ``>`` (right within), lists by commas."""
    chains = [re.sub(r"\s*>\s*", " >", one.strip()).split() for one in selector.split(",")]

    def fit(node: Node, chain: list[str], i: int) -> bool:
        if not fits(node, chain[i].lstrip(">")):
            return False
        if i == 0:
            return not chain[0].startswith(">") or node.parent is root
        up = node.parent
        while up is not None and up is not root:
            if fit(up, chain, i - 1):
                return True
            if chain[i].startswith(">"):
                return False
            up = up.parent
        return False

    return (node for node in root.walk() if any(fit(node, chain, len(chain) - 1) for chain in chains))


def article(html: str | None, selectors: tuple, without: tuple) -> str | None:
    """The text of the first selector that gives enough; one that ends in `` p`` joins the paragraphs of the first element before it."""
    root = tree(html)
    for selector in selectors:
        outer = next(select(root, selector.removesuffix(" p")), None)
        if outer is None:
            continue
        if selector.endswith(" p"):
            gone = set()
            for node in outer.walk():
                if id(node.parent) in gone or any(fits(node, s) for s in without):
                    gone.add(id(node))
            parts = [p.text(without).strip() for p in outer.walk() if p.tag == "p" and id(p) not in gone]
            text = " ".join(p for p in parts if len(p) >= LEAST_PARAGRAPH)
        else:
            text = outer.text(without)
        text = _SPACE.sub(" ", text).strip()
        if len(text) >= LEAST_BODY:
            return text[:MOST_BODY]
    return None


def rule_of(host: str, rules: tuple = ARTICLE_RULES, any_host: tuple | None = None) -> tuple | None:
    """(selectors, without) of the first rule that fits the host or a domain above it."""
    own = host.removeprefix("www.")
    for name, selectors, without in rules:
        if own == name or own.endswith("." + name):
            return selectors, without
    return any_host


def article_bodies(html: Column, url: Column, rules: tuple = ARTICLE_RULES, any_host: tuple | None = ANY_HOST) -> Column:
    """Each page's article by its host's rule; null without a rule (and ``any_host``), or with too little text."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))

    @F.pandas_udf("string")
    def bodies(pages: pd.Series, hosts: pd.Series) -> pd.Series:
        found = {h: rule_of(h or "", rules, any_host) for h in hosts.unique()}
        return pd.Series([None if page is None or found[h] is None else article(page, *found[h]) for page, h in zip(pages, hosts, strict=True)], dtype=object)

    return bodies(html, host)


def list_rows(html: Column, row: str, fields: dict[str, str]) -> Column:
    """An array of structs: for each element that ``row`` selects, its ``fields``.

    A field is ``selector`` for the first such element's text, ``selector@attribute`` for an attribute of it;
    an empty selector is the row itself. What isn't there is null; rows without any field are left out.
    """
    schema = ArrayType(StructType())
    schema.elementType.fields.clear()
    for name in fields:
        schema.elementType.add(name, StringType())
    wanted = [(name, *f.partition("@")[::2]) for name, f in fields.items()]

    def one(node: Node) -> dict:
        out = {}
        for name, selector, attribute in wanted:
            at = next(select(node, selector), None) if selector else node
            out[name] = None if at is None else at.attributes.get(attribute) if attribute else _SPACE.sub(" ", at.text()).strip() or None
        return out

    @F.pandas_udf(schema)
    def rows(pages: pd.Series) -> pd.Series:
        return pd.Series([None if page is None else [r for r in map(one, select(tree(page), row)) if any(v is not None for v in r.values())] for page in pages], dtype=object)

    return rows(html)


def listed(pages: DataFrame, row: str, fields: dict[str, str]) -> DataFrame:
    """(page_id, place, ...) of list pages (page_id, html): a typed row for each element that ``row`` selects."""
    found = pages.select("page_id", F.posexplode(list_rows(F.col("html"), row, fields)).alias("place", "i"))
    return found.select("page_id", F.col("place").cast("long").alias("place"), "i.*")
