"""Template deduction: against a plain version, on pages that give no hints, with repeated rows."""

import collections
import itertools

import pytest

from promptlake.llm import html_text as H
from promptlake.llm.cluster import Scratch

KIND = "page_id bigint, url string, html string"
PLAIN = (
    '<html><body><div class="k1"><div><a href="/">Front</a></div><div><a href="/x">All things</a></div><div>Welcome here</div></div>'
    '<div class="k2"><div class="k3">{title}</div><div class="k4"><p>{body}</p><p>More of {title} <a href="/s">source</a></p></div>'
    '<div>Tell your friends about this</div></div><div class="k5"><div><a href="/1">Next {n}</a></div><div><a href="/2">Then {n}</a></div></div><div class="k6">All rights with us</div></body></html>'
)
ARTICLE = "<html><body><nav><a>Menu</a></nav><article><h1>{title}</h1><p>{body}</p><div class='q1'>Tell your friends about this</div><div class='q2'>Rate what you read</div></article><div class='z'>Imprint</div></body></html>"


def page(template, n):
    return template.format(title=f"Title {n}", body=f"Body number {n} of this host, which says things.", n=n)


def want(n):
    return f"Title {n}\n\nBody number {n} of this host, which says things.\n\nMore of Title {n} source"


@pytest.mark.parametrize("copies", [1, 2, 3, 4])
def test_pages_without_hints(spark, copies):
    rows = [(i, f"http://h.example/{i}", page(PLAIN, i)) for i in range(5)]
    rows += [rows[0]] * (copies - 1)
    got = H.extract(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len(rows)
    assert all(r["text"] == want(r["page_id"]) for r in got)


def test_template_decides_inside_articles(spark):
    rows = [(i, f"http://h.example/{i}", page(ARTICLE, i)) for i in range(6)]
    rows += [(10 + i, f"http://two.example/{i}", page(ARTICLE, i)) for i in range(2)]  # too few pages for a template
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, KIND)).collect()}
    own = [f"Title {i}\n\nBody number {i} of this host, which says things." for i in range(6)]
    assert [got[i] for i in range(6)] == own
    assert got[10] == own[0] + "\n\nTell your friends about this\n\nRate what you read"


def test_an_article_that_fills_a_host_stays(spark):
    """Exact copies count once; near copies stay below the support that texts in articles need."""
    rows = [(i, f"http://h.example/{i}", page(ARTICLE, 0)) for i in range(8)] + [(20 + i, f"http://h.example/{i}", page(ARTICLE, 20 + i)) for i in range(5)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, KIND)).collect()}
    assert all(got[i].startswith("Title 0\n\nBody number 0") for i in range(8))


def test_classes_against_plain_deduction(spark):
    pages = [page(PLAIN, i) for i in range(5)] + [page(ARTICLE, i) for i in range(3)]
    counts = [collections.Counter(t[0] for t in H.parse(p)[0]) for p in pages]
    first = [{h: at for h, at, _ in reversed(H.parse(p)[0])} for p in pages]
    inside = {t[0] for p in pages for t, b in zip([t for t in H.parse(p)[0] if t[2]], H.parse(p)[1], strict=True) if b[1].article}
    classes = collections.defaultdict(set)
    for token in set(itertools.chain.from_iterable(counts)):
        vector = tuple(c[token] for c in counts)
        on = sum(v > 0 for v in vector)
        if on >= max(3, (H.ARTICLE_SUPPORT if token in inside else H.SUPPORT) * len(pages)):
            classes[vector].add(token)
    valid = set()
    for tokens in classes.values():
        orders = {tuple(sorted(tokens, key=at.get)) for at in first if tokens & set(at)}
        if len(tokens) >= H.CLASS_SIZE and len(orders) == 1:
            valid.add(frozenset(tokens))
    rows = spark.createDataFrame([(1, i, p) for i, p in enumerate(pages)], "host bigint, page bigint, html string")
    with Scratch(spark) as scratch:
        found = collections.defaultdict(set)
        for r in H.templates(rows, scratch).collect():
            found[r["class"]].add(r["token"])
    assert {frozenset(x) for x in found.values()} == valid and valid


def test_slots_nest():
    # class 1 at 0, 10, 20; class 2 at 12, 15 inside its second gap; class 3 interleaves with class 4.
    at = [(0, 1), (10, 1), (12, 2), (15, 2), (20, 1), (30, 3), (32, 4), (34, 3), (36, 4)]
    got = H.slots([p for p, _ in at], [c for _, c in at], [5, 11, 13, 16, 25, 33, 35, 40])
    assert got == [(0, 1), (0, 2), (12, 1), (0, 2), (-1, 2), (30, 2), (30, 3), (-1, 3)]
