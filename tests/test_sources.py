"""Strict JSON, the artefact store and resumable commits."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from calibrium.sources import store, strict_json
from calibrium.sources.text import normalize, normalize_text
from calibrium.sources.verbalizers import bytes_as_tokens, library, resolve, resolve_pair, single_token_continuations
from calibrium.streaming import resume
from calibrium.streaming.blocks import BlockStore


@pytest.mark.parametrize("text, why", [('{"a":1}', None), ('{"a":1,"a":2}', "repeated key"), ('{"a":{"b":1,"b":1}}', "repeated key"), ('{"a":Infinity}', "Infinity is no number"), ("1", "not an object"), ("", "not JSON"), (None, "null"), ('{"a":' + "[" * 64 + "]" * 64 + "}", "too deep")])
def test_strict_json(text, why):
    assert strict_json.reason(text) == why


def test_normalized_text(spark):
    texts = [" a\r\nb\rc\x1f ", "\u00a0e\u0301\r\n ", "", None, "\x0b\x0c", "plain", "ﬁ\r", " \u2003x\x85", "a\x00 "]
    got = {r.k: r.t for r in spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", normalize_text(F.col("s")).alias("t")).collect()}
    assert got == {k: None if t is None else normalize(t) for k, t in enumerate(texts)}


def test_store_round_trip(spark, tmp_path):
    s = store.ArtefactStore(spark, f"file://{tmp_path}/store")
    fp = s.put({"slope": 1.5, "name": "é"})
    assert s.put({"name": "é", "slope": 1.5}) == fp and s.get(fp) == {"slope": 1.5, "name": "é"}
    s.files.publish(s.path(fp), '{"slope":1.6}')
    with pytest.raises(store.StoreError, match="another fingerprint"):
        s.get(fp)
    with pytest.raises(store.StoreError, match="absent"):
        s.get("0" * 64)
    assert not list(tmp_path.rglob(".new-*"))


def test_publishing_replaces_whole_texts(spark, tmp_path):
    f = store.Files(spark)
    for text in ("first", "second ü"):
        f.publish(f"file://{tmp_path}/a/b.txt", text)
    assert f.read(f"file://{tmp_path}/a/b.txt") == "second ü" and "b.txt" in f.names(f"file://{tmp_path}/a")
    (tmp_path / "folder").mkdir()
    (tmp_path / "file").write_text("x")
    assert [f.state(f"file://{tmp_path}/{x}") for x in ("a/b.txt", "folder", "nothing", "file/below")] == ["PRESENT", "DAMAGED", "ABSENT", "DAMAGED"]


def test_blocks_go_on_where_they_stopped(spark, tmp_path):
    s = BlockStore(spark, f"file://{tmp_path}/blocks")
    work = lambda b: spark.range(int(b)).selectExpr(f"'{b}' as block", "id") if b != "3" else spark.sql("select raise_error('stop') as block, 1L as id")
    with pytest.raises(Exception, match="stop"):
        s.run(["1", "2", "3", "4"], work)
    assert s.done() == {"1", "2"}
    again = s.run(["1", "2", "3", "4"], lambda b: spark.range(int(b)).selectExpr(f"'{b}' as block", "id"))
    assert again == ["3", "4"] and s.rows().count() == 10


def test_library_continuations(spark):
    import public_tokenizers

    tokenize = library(public_tokenizers.path("byte_bpe_50k.json"))
    prompts = spark.createDataFrame([(1, "Is it so?"), (2, "Is it so? "), (3, None), (1, "Is it so?")], "item_id long, prompt string")
    got = sorted((r.item_id, r.label, r.token_id) for r in single_token_continuations(prompts, "prompt", ["yes", "undecidable"], tokenize).collect())
    want = sorted((i, x, resolve(tokenize, p or "", x)) for i, p in ((1, "Is it so?"), (2, "Is it so? "), (3, None), (1, "Is it so?")) for x in ("yes", "undecidable"))
    assert repr(got) == repr(want) and got[2] == (1, "yes", 3763)


def test_verbalizers():
    assert resolve(bytes_as_tokens, "a b", "yes") is not None
    assert resolve(bytes_as_tokens, "a b", "two words") is None
    assert resolve_pair(bytes_as_tokens, "a", "yes", "yes") is None


def test_commits_are_idempotent(spark, tmp_path):
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    spark.range(10).write.parquet(src)
    assert resume.commit_stream(spark, src, "id long", out, state, "id") == 10
    spark.range(5, 15).write.mode("append").parquet(src)
    assert resume.commit_stream(spark, src, "id long", out, state, "id") == 15
    assert resume.repeated(spark.read.parquet(out), "id").count() == 0


def test_commits_read_the_parts_of_their_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resume, "RANGE", 100)
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for lo, n in ((0, 250), (200, 350)):
        spark.range(lo, lo + n).write.mode("append").parquet(src)
        assert resume.commit_stream(spark, src, "id long", out, state, "id") == lo + n
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"_part={k}" for k in range(6)}
    names = [f"file://{tmp_path}/{x}" for x in ("words", "words-out", "words-state")]
    spark.sql("select explode(split('a b c a', ' ')) as w").write.parquet(names[0])
    assert resume.commit_stream(spark, names[0], "w string", *names[1:], "w") == 3
