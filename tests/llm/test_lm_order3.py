"""The registered trigram query against brute force over the whole table."""

import collections
import math
import os
import re
import string

import pytest

from promptlake.llm import queries

D = "/root/testdata/sf0.001"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def grams(w, n):
    return zip(*(w[i:] for i in range(n)), strict=False)


@pytest.mark.skipif(not os.path.isdir(D), reason="driver tables absent")
def test_order_3_is_registered(spark):
    texts = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOW)) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    everywhere = collections.Counter(g for w in texts.values() for n in (1, 2, 3) for g in grams(w, n))
    total = sum(map(len, texts.values()))
    want = {}
    for doc, w in texts.items():
        own = collections.Counter(g for n in (1, 2, 3) for g in grams(w, n))
        s = 0.0
        for j in range(len(w)):
            most = min(3, j + 1)
            for n in range(most, 1, -1):
                g = tuple(w[j - n + 1 : j + 1])
                c, h = everywhere[g] - own[g], everywhere[g[:-1]] - own[g[:-1]]
                if c and h:
                    s += math.log(c / h) + (most - n) * math.log(0.4)
                    break
            else:
                c = everywhere[w[j],] - own[w[j],]
                s += (math.log(c / (total - len(w))) if c else -math.log(total - len(w) + 1)) + (most - 1) * math.log(0.4)
        want[doc] = (len(w), s)
    got = {r["doc_id"]: (r["n_tokens"], r["log_score"]) for r in queries.QUERIES["op2_lm_score_order3"](spark, D).collect()}
    assert set(got) == set(want)
    for doc, (n, s) in want.items():
        assert got[doc][0] == n and got[doc][1] == pytest.approx(s, abs=2e-3)
