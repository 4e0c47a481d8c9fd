"""The pipeline against each stage's brute force, and rows with nulls."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from calibrium.llm._shared import Tables

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the test tables are not here")


def test_stages(spark):
    raw = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [r.text.lower().split() for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "123 456", "en", "s", 7), (90003, bench and " ".join(bench[0]), None, "s", None), (90004, raw.first().text, "en", "s", 1), (None, "the of and the of and", "en", "s", 2)], raw.schema)
    docs, tables, seen = raw.unionByName(odd), Tables(spark, "test-pipeline"), {}
    columns = docs.columns
    for name, stage in P.STAGES:
        docs = tables.cut(stage(spark, docs, str(DATA)))
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
    ids = {k: set(v) for k, v in seen.items()}
    all_ids = {r.doc_id for r in raw.select("doc_id").collect()}
    assert not {90001, 90002} & ids["language_id"] and len(all_ids - ids["language_id"]) <= 0.05 * len(all_ids)
    assert 90004 not in ids["near_dedup"] and raw.first().doc_id in ids["near_dedup"] and None in ids["near_dedup"]
    assert 90003 not in ids["decontaminate"]
    grams = {tuple(b[i : i + 50]) for b in [[]] for i in range(len(b) - 49)}
    for r in seen["substring_dedup"].values():
        w = r.text.lower().split()
        own = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        assert not own & grams  # a passage stands in one document
        grams |= own
    for i, r in seen["sentencepiece"].items():
        assert r.n_chars == len(seen["decontaminate"][i].text) and r.n_tokens == len(r.ids)


def test_copies_of_four_fifths_are_near_duplicates(spark):
    w = [f"w{k}" for k in range(300)]
    texts = {1: w, 2: [f"x{k}" if k % 50 == 25 else t for k, t in enumerate(w)], 3: [f"y{k}" if k % 40 == 20 else t for k, t in enumerate(w[:200])]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    # similarities to the first: 266 of 326 shingles, 171 of 321
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_stages_keep_columns_with_any_names(spark):
    w = [f"w{k}" for k in range(200)]
    long = " ".join(w)
    rows = [(1, long, "en", 1, True, "p"), (2, "before " * 9 + " ".join(w[:150]), "en", 2, False, "q"), (2, "before " * 9 + " ".join(w[:150]), "en", 1, False, "q"), (None, long, "en", 3, True, "r"), (4, None, None, 4, None, None), (5, "  ", "en", 5, True, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, _cut boolean, `removal_spans` string").selectExpr("*", "'x' as owner", "'y' as was_cut", "1 as first", "2 as hash", "3 as spans", "array(1) as bands")
    for stage in (P.drop_near_duplicates, P.cut_repeated_passages):
        got = stage(spark, docs, str(DATA))
        assert got.columns == docs.columns and {r.owner for r in got.collect()} == {"x"}
    near = {(r.doc_id, r.n_chars) for r in P.drop_near_duplicates(spark, docs, str(DATA)).collect()}
    assert near == {(1, 1), (2, 1), (None, 3), (4, 4), (5, 5)}  # of repeated rows the first by its other columns
    cut = {(r.doc_id, r.text, r.n_chars, r._cut) for r in P.cut_repeated_passages(spark, docs, str(DATA)).collect()}
    assert (1, long, 1, True) in cut and (None, long, 3, True) in cut and (4, None, 4, None) in cut
    assert {tuple(t.split()) for i, t, _, _ in cut if i == 2} == {("before",) * 9}
    bad = P.drop_contaminated(spark, docs, str(DATA))
    assert bad.columns == docs.columns and bad.count() == len(rows)
    known = P.identify_language(spark, docs.withColumn("rejected", F.lit(1)), str(DATA))
    assert known.columns == [*docs.columns, "rejected"] and 4 not in {r.doc_id for r in known.collect()}


def test_run_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
