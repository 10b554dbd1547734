"""The operators on small tables: brute force, nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlake.llm.cluster import Scratch
from promptlake.llm import components, decontaminate, html_text, line_dedup, lm_score, near_dedup, packing, quality_model, quality_rules, token_counts, token_files

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, node bigint, group string, n int"
A = " ".join(f"alpha{i} beta{i}" for i in range(40))
LINE = "This line stands in Many documents."


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def rows():
    texts = {1: A, 2: A, 3: A.replace("alpha7 ", "gamma "), 4: None, 5: "", 6: " \n\t", 7: "one", 8: "one", 9: "two words", 10: f"  {LINE.upper()}  \nx\n{LINE}", 11: f"{LINE}\n", 12: LINE, 13: "long " * 30_000, 14: f"head {A} tail", 15: "###$$$ %%% " * 60}
    out = [(i, t, "en" if i % 3 else None, "src" if i % 4 else None, len(t or ""), "clash", 3, "g", 1) for i, t in texts.items()]
    return [*out, out[0], (None, "no id here", "en", "src", 10, "clash", 3, "g", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path


# -- near duplicates ------------------------------------------------------------------------


def brute_components(pairs, k):
    sets = {}
    for i, t in pairs:
        w = words(t)
        sets[i] = set(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    while True:
        new = {i: min(label[j] for j in sets if j == i or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))) for i in sets}
        if new == label:
            return sets, label
        label = new


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    sets, label = brute_components([(r[0], r[1]) for r in rows() if r[0]], k)
    got = near_dedup.near_duplicates(docs, k).collect()
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_dense_groups(spark):
    """More near copies than a small node holds, some of them only just alike or just not."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    pairs = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(60, rng.integers(0, 6), replace=False):
            w[j] = f"edit{rng.integers(0, 40)}"
        pairs.append((i, " ".join(w)))
    pairs += [(1000 + i, " ".join(f"z{i}x{j}" for j in range(30))) for i in range(50)]
    _, label = brute_components(pairs, 2)
    got = near_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id bigint, text string"), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == label
    assert len(set(label.values())) > 52


def test_near_duplicates_of_nothing(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    assert near_dedup.one_of_each(nothing).columns == nothing.columns


def test_one_of_each_keeps_columns(docs):
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(1) == 2 and None in kept and not {2, 8} & set(kept) and {4, 5, 6, 13, 15} <= set(kept)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (6, 5), (7, 7)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {100 + i: 100 for i in range(31)}


def test_components_of_random_graphs_and_merges(spark):
    rng = np.random.default_rng(5)
    for n in (30, 80):
        edges = [tuple(map(int, e)) for e in rng.integers(0, 100, (n, 2))]
        label = {v: v for e in edges for v in e}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        frame = lambda some: spark.createDataFrame(some, "a bigint, b bigint")
        alone = {v for a, b in edges if a == b for v in (a,)} - {v for a, b in edges if a != b for v in (a, b)}
        want = {v: c for v, c in label.items() if v not in alone}
        assert {r["node"]: r["component"] for r in components.connected_components(frame(edges)).collect()} == want
        with Scratch(spark) as scratch:
            comps = scratch.cut(components.connected_components(frame(edges[: n // 2]), scratch))
            assert {r["node"]: r["component"] for r in components.merged(comps, frame(edges[n // 2 :]), scratch).collect()} == want


# -- lines ------------------------------------------------------------------------------------


def test_line_dedup(docs, nothing):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(strip).translate(LOW)
    held = collections.defaultdict(set)
    for r in rows():
        for x in (r[1] or "").split("\n"):
            held[key(x)].add(-1 if r[0] is None else r[0])
    out = line_dedup.dedupe_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    for r in out.collect():
        t = next(x[1] for x in rows() if x[0] == r["doc_id"])
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != r["doc_id"])]
        assert (r["text"], r["n_lines"], r["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedupe_lines(nothing).count() == 0


def test_clashing_columns(docs):
    """Extra columns with the names of an operator's own ones stay as they are."""
    wide = docs.select("*", *(F.lit("mine").alias(c) for c in ("n_lines", "n_dropped", "lost", "_gone", "_doc", "component", "copies", "key", "_levels", "x0")))
    out = line_dedup.kept_lines(wide)
    assert out.columns == wide.columns
    texts = {(r["doc_id"], r["text"], r["n_dropped"]) for r in line_dedup.dedupe_lines(docs).collect()}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {t[:2] for t in texts}
    assert all(r["n_lines"] == r["n_dropped"] == r["lost"] == "mine" and (r["n_chars"] == len(r["text"]) or not any(t[0] == r["doc_id"] and t[2] for t in texts)) for r in out.collect())
    assert line_dedup.dedupe_lines(wide).columns == [*(c for c in wide.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped"]
    for whole in (near_dedup.one_of_each(wide), quality_rules.kept_documents(wide)):
        assert whole.columns == wide.columns and {r["_gone"] for r in whole.collect()} == {"mine"}


def test_periodic_lines_differ(spark):
    """A Thue-Morse line and its complement, which weak hashes do not tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    got = line_dedup.dedupe_lines(spark.createDataFrame([(1, one), (2, one), (3, two)], "doc_id bigint, text string")).collect()
    assert all(r["n_dropped"] == 0 for r in got)


# -- quality ----------------------------------------------------------------------------------


def test_quality_rules(spark, docs, nothing):
    got = {r["doc_id"]: r for r in quality_rules.verdicts(docs).collect()}
    assert got[1]["n_words"] == 80 and got[1]["kept"] and not got[1]["base_failed"]
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (4, 5, 6, 7, 13, 15))
    assert quality_rules.verdicts(nothing).count() == 0
    assert sorted(r["doc_id"] or 0 for r in quality_rules.kept_documents(docs).collect()) == [1, 1, 2, 3, 14]
    rng = np.random.default_rng(1)
    vocabulary = [a + b for a in ("ri", "sto", "wal", "und", "gre", "lam") for b in ("ver", "ne", "ks", "er", "en", "ps")]
    good = [(i, " ".join(rng.choice(vocabulary, 120)) + ".", "en", "s") for i in range(200)]
    bad = [(900 + i, " ".join(f"{w}###" for w in rng.choice(["river", "stone", "walks"], 40)) + " " + " ".join(f"Q{j}" for j in range(40)), "en", "s") for i in range(6)]
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.verdicts(spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(judged[900 + i] for i in range(6))
    assert sum(judged[i] for i in range(200)) >= 198


def test_quality_model(spark, docs, nothing):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 14)] + [(15, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_model.score(docs, labels).collect()
    assert len(got) == len(rows())
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert quality_model.score(nothing, labels).count() == 0
    assert {r["score"] for r in quality_model.score(docs, labels.limit(0)).collect()} == {0.5}


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 2000)
    assert quality_model.estimate_prior(p, np.concatenate([rng.normal(2, 1, 6000), n])) == pytest.approx(0.75, abs=0.04)


def test_quality_model_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9


# -- tokens -----------------------------------------------------------------------------------


def test_packing(docs, nothing, tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    got = packing.pack(docs, path).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 13)
    assert [x[0] for x in long] == list(range(len(long))) and all(x[2] == 2048 for x in long[1:])
    assert [(r["length"], r["piece"]) for r in got if r["doc_id"] == 4] == [(1, 0)]
    assert len(by) == -(-sum(r["length"] for r in got) // 2048)
    assert packing.pack(nothing, path).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(3)
    for _ in range(6):
        size = rng.integers(1, 65, 300)
        p = packing.plan(dict(zip(*np.unique(size, return_counts=True), strict=True)), 64)
        used = collections.Counter(p["length"].tolist())
        assert set(used) == set(size.tolist())
        assert p["sequences"][0] <= 1.05 * size.sum() / 64 + 2


def test_token_files(spark, docs, nothing, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    token_files.write(docs, f"{tmp_path}/f", path)
    got = token_files.digests(token_files.read(spark, f"{tmp_path}/f")).collect()
    plain = Tokenizer.from_file(path)
    at = 0
    for r, g in zip(sorted(rows(), key=lambda r: -1 if r[0] is None else r[0]), sorted(got, key=lambda g: g["start"]), strict=True):
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write(nothing, f"{tmp_path}/n", path)
    assert token_files.read(spark, f"{tmp_path}/n").count() == 0


def test_fast_ids_are_the_librarys(tokenizer):
    from tokenizers import Tokenizer

    from promptlake.llm.tokens import encoder

    texts = ["a²b ½ x  y\n\n z", "İstanbul", "日本 語", "don't   stop!!'s\t\t x\x85y  12345 ñandú Äöß ŒUVRE  ", "", "  ", "\n\n\n", " a b", "<|endoftext|> x", "a­b ́e"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        plain = Tokenizer.from_file(tokenizer(name))
        plain.encode_special_tokens = True
        assert encoder(tokenizer(name)).encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_token_counts(docs, nothing, tokenizer):
    path = tokenizer("piece_bpe_32k.model")
    initial, internal = map(set, token_counts.vocabulary(path))

    def greedy(w):
        i = n = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in (internal if i else initial)), None)
            if j is None or len(w) > token_counts.MAX_WORD:
                return 1
            i, n = j, n + 1
        return n

    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()}
    for r in rows():
        assert got[r[0]] == sum(map(greedy, re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")))
    assert token_counts.token_counts(nothing, path).count() == 0


# -- language model, benchmark, pages ---------------------------------------------------------


@pytest.mark.parametrize(("order", "batch", "bits"), [(1, 4000, 6), (2, 4000, 6), (3, 4000, 6), (2, 12000, 1), (3, 20000, 2)])
def test_lm_score(spark, docs, nothing, order, batch, bits, monkeypatch):
    """The last two have more batches than meet at once, so totals go through several levels."""
    monkeypatch.setattr(lm_score, "BATCH_BYTES", batch)
    monkeypatch.setattr(lm_score, "BITS", bits)
    texts = [(i, words(r[1])) for i, r in enumerate(rows())]
    count = [collections.Counter(tuple(w[i : i + n]) for _, w in texts for i in range(len(w) - n + 1)) for n in range(order + 1)]
    total = sum(len(w) for _, w in texts)
    want = collections.defaultdict(list)
    for i, w in texts:
        own = [collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(order + 1)]
        left = lambda g: count[len(g)][g] - own[len(g)][g]  # noqa: B023, E731
        s = 0.0
        for j in range(len(w)):
            most = min(order, j + 1)
            for n in range(most, 0, -1):
                g = tuple(w[j - n + 1 : j + 1])
                if n == 1:
                    s += (np.log(left(g) / (total - len(w))) if left(g) else -np.log(total - len(w) + 1)) + (most - 1) * np.log(0.4)
                elif left(g) and left(g[:-1]):
                    s += np.log(left(g) / left(g[:-1])) + (most - n) * np.log(0.4)
                    break
        want[rows()[i][0]].append((len(w), s))
    got = collections.defaultdict(list)
    for r in lm_score.score(docs, order).collect():
        got[r["doc_id"]].append((r["n_tokens"], r["log_score"]))
    assert set(got) == set(want)
    for k in want:
        assert np.allclose(sorted(got[k]), sorted(want[k]))
    assert lm_score.score(nothing, order).count() == 0


def test_decontamination(spark, docs, nothing):
    b = spark.createDataFrame([(1, A), (2, None), (3, "two words"), (4, "not there at all in any text"), (5, "One"), (5, "one")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained(docs, b).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (14, 1), (9, 3), (7, 5), (8, 5)}
    clean = decontaminate.clean_documents(docs, b)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {None, 4, 5, 6, 10, 11, 12, 13, 15}
    assert decontaminate.contained(nothing, b).count() == 0
    assert decontaminate.contained(docs, b.limit(0)).count() == 0
    assert decontaminate.clean_documents(docs, b.limit(0)).count() == len(rows())


def test_main_text(spark):
    page = """<html><head><title>x</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav>{top}<article><header><h1>Head &amp; line {n}</h1></header>
<p>One {n} <a href="#">two</a>\n three&nbsp;four<div class="sidebar widget">side</div><p>five < 6 and <i>seven</i> {n}</p><form><p>Name<input></form><section id="comments"><p>nice post</p></section></article><footer>f</footer><!-- <p>no</p> --><script>if(a<b){"<p>"}</script></body>"""
    soup = '<html><body><div id="menu">m</div><div>Welcome to this site, dear reader</div><div class="story"><p>Story {n} is told here</p></div><div class="foot">All rights reserved by us</div></body></html>'
    data = [(i, f"http://a.example/{i}", page.replace("{n}", str(i)).replace("{top}", '<div class="cookie-notice">We use cookies</div>')) for i in range(5)]
    data += [(100 + i, f"http://b.example/{i}", soup.replace("{n}", str(i))) for i in range(6)]
    data += [(200, "http://c.example/", None), (201, None, ""), (202, "x", "<p>a</p><p>b"), (202, "x", "<p>a</p><p>b")]
    pages = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("host", F.lit(1)).withColumn("token", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for i in range(5):
        assert got[i]["text"] == f"Head & line {i}\n\nOne {i} two three four\n\nfive < 6 and seven {i}"
        assert got[i]["n_chars"] == len(got[i]["text"])
    for i in range(6):
        assert got[100 + i]["text"] == f"Story {i} is told here"
    assert (got[200]["text"], got[201]["text"], got[202]["text"]) == ("", "", "a\n\nb")
    assert html_text.extract(pages.limit(0)).count() == 0
