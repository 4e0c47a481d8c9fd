"""Ranked search against a plain scorer over every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from calibrium.llm import lexical_search as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, k):
    counts = [(i, Counter(cut(t))) for i, t in docs]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def rows():
    base = [(i, " ".join(f"W{(i * j) % 23}" for j in range(1, 2 + i % 40))) for i in range(1, 150)]
    odd = [(500, None), (501, ""), (502, "--- \n\t"), (None, "w1 w2 w3"), (None, None), (7, "w1 w1 w2"), (7, "w1 w1 w2"), (7, "w5"), (600, "É é É w1\x00w2"), (601, "w1 " * 30_000), (602, "x" * 100_000), (603, "K w1 ſw2 𝒳y")]
    return base + odd


ITEMS = [(1, "w1 W2 w1 w22"), (2, "É é w3"), (3, None), (4, ""), (5, "nowhere"), (1, "w5"), (None, "w7 w8"), (6, "x" * 100_000), (7, "K 𝒳y ſw2")]


@pytest.mark.parametrize(("chunk", "k"), [(1024, 5), (7, 50)])
def test_search_equals_a_plain_scorer(spark, monkeypatch, chunk, k):
    # small chunks: a term's postings lie in several chunks and buckets
    monkeypatch.setattr(L, "MOST_BYTES", 0 if chunk < 100 else L.MOST_BYTES)
    docs = spark.createDataFrame([(a, b, "x", 3) for a, b in rows()], "doc_id long, text string, term string, chunk int").repartition(3)
    docs.write.mode("overwrite").parquet(path := spark.sparkContext.getCheckpointDir() + f"/search-{chunk}")
    items = spark.createDataFrame([(a, b, 0) for a, b in ITEMS], "item_id long, text string, doc_id int")
    index = L.build_index(spark.read.parquet(path), chunk_docs=chunk, chunk_bytes=1 << 20 if chunk > 100 else 1 << 12)
    assert index.rows.where("bucket = -1").count() >= (20 if chunk < 100 else 1)
    got = L.search(index, items, k)
    assert sorted([tuple(r) for r in got.collect()], key=lambda r: (r[0] is None, r[0] or 0, r[1])) == brute(rows(), ITEMS, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert L.search(L.build_index(docs), some.selectExpr("doc_id as item_id", "text")).count() == 0
    assert L.search(L.build_index(some), items).count() == 0
