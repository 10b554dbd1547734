"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: start tags, told apart by their path of enclosing
elements and classes, and texts with the path they stand in. On each host the tokens
whose occurrence vectors over the pages agree (as often on every page) form an
equivalence class. The vector is kept as a hash over (page, count), so the classes come
from grouped aggregation however many pages a host has. A class is valid if it has enough
tokens, occurs on enough pages and its tokens stand in one order on every page.

On a page the classes nest by position: a class whose tokens all stand in one gap of another
is inside it, and classes that interleave count as one. The gaps are the slots. A text that is itself a template token is
fixed wording of the host; other texts are slot contents. The main text is chosen among the
slots: those that hold the page's article (article or main element, or what says to be one) or, failing
one, those that are not mostly links. In them the template decides first. As a second
filter, blocks go whose enclosing elements are menus, headers, footers, sidebars,
notices, adverts, forms or comments.

Texts inside an article are fixed wording only from ``ARTICLE_SUPPORT`` of the host's pages on,
since near copies of one article can fill a host. Pages are counted by distinct html, so
that repeated rows and exact copies count once; each row still gets its text. Hosts with
fewer than ``LEAST_PAGES`` distinct pages have no template; there the elements decide alone.
Null or empty html gives an empty text; a null url is a host of its own. Other columns of
the input, whatever their names, take no part.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch, keep

LEAST_PAGES = 4
SUPPORT, ARTICLE_SUPPORT = 0.6, 0.8
MOSTLY = 0.6
CLASS_SIZE = 3
TOKENS_BOUND = 2_000_000

#: HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "canvas", "audio", "video")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("head nav aside footer form menu dialog button label input fieldset option".split())
CLOSED_BY = {"p": BLOCK, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "option": frozenset({"option"})}
BOILERPLATE = frozenset("""
    ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist
    consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices
    pagination paywall popup promo promoted promotion recommended related respond responses share sharing sidebar sidebars social
    sponsor sponsored subscribe subscription toolbar widget widgets
""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attr>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attr2>[^>]*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|aria-hidden|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("name", "path", "outside", "article", "link", "strict")

    def __init__(self, name: str, attributes: str, above: Element | None):
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attributes)} if attributes else {}
        classes = found.get("class", "").split()
        self.name = name
        self.path = hash_text(f"{above.path if above else 0}/{name}.{'.'.join(sorted(classes))}")
        self.article = (above.article if above else False) or name in ("article", "main") or found.get("role") in ("main", "article") or "articlebody" in found.get("itemprop", "")
        self.link = (above.link if above else False) or name == "a"
        self.outside = (above.outside if above else False) or self._aside(name, classes, found, above)

    def _aside(self, name: str, classes: list[str], found: dict, above: Element | None) -> bool:
        if name in OUTSIDE or found.get("role") in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
            return True
        if name == "header":  # an article's own header holds its headline
            return not (above and above.article)
        if name in ("html", "body", "article", "main"):
            marks = {m for c in classes for m in (c,)} & {"comment", "comments", "ad", "ads", "advert", "promo", "related"}
            return bool(marks)
        words = [c for c in [*classes, found.get("id", "")] if c]
        return any(c in BOILERPLATE or not BOILERPLATE.isdisjoint(_PART.split(c)) for c in words)


def hash_text(text: str) -> int:
    import zlib

    raw = text.encode()
    return (zlib.crc32(raw) << 32 | zlib.adler32(raw)) & 0x7FFFFFFFFFFFFFFF


def parse(page: str) -> tuple[list[tuple[int, int, bool]], list[tuple[str, Element, float]]]:
    """Tokens (hash, position, text?) and blocks (text, innermost element, share in links) of a page, in order."""
    stack: list[Element] = [Element("", "", None)]
    tokens: list[tuple[int, int, bool]] = []
    blocks: list[tuple[str, Element, float]] = []
    held: list[str] = []
    linked = total = 0
    home = stack[-1]

    def close() -> None:
        nonlocal linked, total
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            tokens.append((hash_text(f"{home.path}\n{text}"), len(tokens), True))
            blocks.append((text, home, linked / max(total, 1)))
        linked = total = 0

    def text(raw: str) -> None:
        nonlocal linked, total, home
        if raw:
            if not raw.isspace():
                if not total:
                    home = stack[-1]
                total += len(raw)
                linked += len(raw) * stack[-1].link
            held.append(raw)

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if not m["raw"] and m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if name == "br":
            held.append("\n")
            continue
        end, attributes = m["end"] or m["end2"], m["attr"] or m["attr2"] or ""
        if name in BLOCK:
            close()
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    # A misplaced inline end tag must not close the block around it.
                    if name in BLOCK or not any(e.name in BLOCK for e in stack[i + 1 :]):
                        del stack[i:]
                    break
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1].name, ()):
            stack.pop()
        if name in BLOCK:  # an open inline element or paragraph ends where a block begins
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in BLOCK), 0)
            if stack[i].name == "p":
                del stack[i:]
            elif i and name in ("p", "li", "div", "h1", "h2", "h3", "h4", "h5", "h6"):
                del stack[i + 1 :]
        element = Element(name, attributes, stack[-1])
        tokens.append((element.path, len(tokens), False))
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(element)
    text(page[at:])
    close()
    return tokens, blocks


def slots(positions: list[int], classes: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The slot (innermost class, gap in it) of each position in ends. positions, classes: the template tokens of a page, in order.

    The class is named by its first position on the page, -1 outside of all.
    """
    span: dict[int, list[int]] = {}
    for p, c in zip(positions, classes, strict=True):
        span.setdefault(c, [p, p])[1] = p
    tree: list[list] = []  # [first, last, classes]; interleaving classes are joined
    for c, (first, last) in sorted(span.items(), key=lambda x: (x[1][0], -x[1][1])):
        for node in reversed(tree):
            if node[0] < first < node[1] < last:
                node[1] = last
                node[2].add(c)
                break
        else:
            tree.append([first, last, {c}])
    out, held, to = [], [], 0
    marks: dict[int, list[int]] = {}
    owner = {c: i for i, node in enumerate(tree) for c in node[2]}
    for p, c in zip(positions, classes, strict=True):
        marks.setdefault(owner[c], []).append(p)
    for p in ends:
        while to < len(tree) and tree[to][0] <= p:
            held.append(to)
            to += 1
        held = [i for i in held if tree[i][1] >= p]
        inner = max(held, key=lambda i: tree[i][0], default=None)
        out.append((-1, to) if inner is None else (tree[inner][0], bisect_right(marks[inner], p)))
    return out


def main_text(tokens: list[tuple[int, int, bool]], blocks: list[tuple[str, Element, float]], template: np.ndarray, classes: np.ndarray) -> str:
    """The main text of a parsed page. template: sorted hashes of the host's template tokens; classes: their classes."""
    fixed = np.zeros(len(tokens), dtype=bool)
    if len(template):
        own = np.array([t[0] for t in tokens], dtype=np.int64)
        at = np.minimum(np.searchsorted(template, own), len(template) - 1)
        fixed = template[at] == own
    text_at = [i for i, t in enumerate(tokens) if t[2]]
    marks = np.flatnonzero(fixed)
    slot = slots(marks.tolist(), classes[at[marks]].tolist() if len(marks) else [], text_at)
    content = [(s, b) for i, s, b in zip(text_at, slot, blocks, strict=True) if not fixed[i] and not b[1].outside]
    if any(b[1].article for _, b in content):
        return "\n\n".join(b[0] for _, b in content if b[1].article)
    links: dict[tuple, list[float]] = {}
    for s, b in content:
        x = links.setdefault(s, [0.0, 0.0])
        x[0] += b[2] * len(b[0])
        x[1] += len(b[0])
    return "\n\n".join(b[0] for s, b in content if links[s][0] <= MOSTLY * links[s][1])


# -- templates ----------------------------------------------------------------------------


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, n, at, inside): each page's tokens, how often, where first, and whether they are texts in its article."""

    def run(batches):
        for b in batches:
            row, token, n, at, inside = [], [], [], [], []
            for i, source in enumerate(b.column(2).to_pylist()):
                seen: dict[int, list] = {}
                tokens, blocks = parse(source or "")
                article = iter([x[1].article for x in blocks])
                for h, position, is_text in tokens:
                    in_article = next(article) if is_text else False
                    seen.setdefault(h, [0, position, in_article])[0] += 1
                row += [i] * len(seen)
                token += seen
                n += [x[0] for x in seen.values()]
                at += [x[1] for x in seen.values()]
                inside += [x[2] for x in seen.values()]
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(token, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(inside, pa.bool_())], names=["host", "page", "token", "n", "at", "inside"])

    return pages.mapInArrow(run, "host bigint, page bigint, token bigint, n int, at int, inside boolean")


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, token, class) of the valid equivalence classes. pages: host, page (hash of its html) and html."""
    tokens = scratch.cut(_tokens(pages).dropDuplicates(["host", "page", "token"]))
    sizes = tokens.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    vectors = tokens.groupBy("host", "token").agg(F.count("*").alias("on"), F.bit_xor(F.xxhash64("page", "n")).alias("class"), F.max("inside").alias("inside"))
    support = F.when(F.col("inside"), ARTICLE_SUPPORT).otherwise(SUPPORT)
    frequent = scratch.cut(vectors.join(sizes, "host").where(F.col("on") >= F.greatest(F.lit(3), support * F.col("pages"))).select("host", "token", "class"))
    large = frequent.groupBy("host", "class").agg(F.count("*").alias("size")).where(F.col("size") >= CLASS_SIZE).drop("size")
    member = scratch.cut(frequent.join(large, ["host", "class"]))
    # Ordered: each page has the class's tokens in one and the same order.
    placed = tokens.select("host", "page", "token", "at").join(member, ["host", "token"])
    orders = placed.groupBy("host", "class", "page").agg(F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])).alias("order"))
    valid = orders.groupBy("host", "class").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a = b").select("host", "class")
    return member.join(valid, ["host", "class"]).select("host", "token", "class")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    base = pages.select("page_id", "url", F.col("html").alias("_html"), F.xxhash64(_host(F.col("url"))).alias("_host"))
    with Scratch(pages.sparkSession) as scratch:
        found = templates(base.select(F.col("_host").alias("host"), F.xxhash64("_html").alias("page"), F.col("_html").alias("html")), scratch)
        by_host = keep(found.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("token", "class"))).alias("t")).select("host", F.col("t.token").alias("_token"), F.col("t.class").alias("_class"), F.size("t").alias("_n")))
    small = by_host.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"] <= TOKENS_BOUND
    by_host = by_host.drop("_n")
    both = base.join(F.broadcast(by_host) if small else by_host, F.col("_host") == F.col("host"), "left").select("page_id", "url", "_html", "_token", "_class")

    def run(batches):
        for b in batches:
            texts = []
            for source, token, kind in zip(b.column(2).to_pylist(), _lists(b.column(3)), _lists(b.column(4)), strict=True):
                texts.append(main_text(*parse(source), token, kind) if source else "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def _lists(column: pa.Array):
    """Each row's list as an array; an empty one for null."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    for a, b in pairwise(edge):
        yield flat[a:b]
