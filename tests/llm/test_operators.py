"""Operators against brute force, on small rows with nulls, empties, ties, repeats and extra columns."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrium.llm import _kernels as K
from calibrium.llm import decontaminate, fingerprints, language_id, lm_scoring, near_dedup, queries, sentencepiece_scan, substring_dedup, token_files, url_rules, warc
from calibrium.llm._merges import boundary_states, combine, pieces
from calibrium.llm._shared import ordered_buckets

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(1, 6))) for _ in range(400)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


def edited(w, k, seed):
    r, w = random.Random(seed), list(w)
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return w


@pytest.fixture(scope="module")
def docs():
    base, passage = words(300, 1), words(60, 2)
    texts = [base, base, *[edited(base, k, k) for k in range(1, 13)], words(120, 3) + passage + words(40, 4), passage + words(200, 5), words(250, 6), words(3, 7), words(3, 7), words(1, 8)]
    rows = [(10 * i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, " ".join(base)), (1003, "É " * 7 + "1 2 3"), (0, " ".join(base)), (1004, "w" * 5000), (1005, " ".join(words(30000, 9)))]
    rows += [(1006, " ".join(base).upper()), (1007, " ".join(words(20, 10)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "kept?", 1) for a, b in rows], "doc_id long, text string, component_id string, spans int")


def spaced(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def test_near_duplicates(spark, docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, docs)).collect())
    sets = [(i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])) for i, w in ((i, spaced(t)) for i, t in docs)]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    want = sorted((i is None, i or 0, len(s), None if i is None else find(i), i is not None and find(i) == i) for i, s in sets)
    assert got == want


def test_near_duplicates_of_a_large_similar_group(spark):
    base = words(150, 20)
    rows = [(i, " ".join(edited(base, i % 9, 1000 + i))) for i in range(160)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    sets = [frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for w in (spaced(t) for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(rows))}


def test_near_duplicates_within_a_template_family(spark):
    # all are 60 to 80 % alike, as they share a template; some of them have copies with two words changed
    template, rows = words(160, 30), []
    for i in range(150):
        own = [f"own{i}x{k}" for k in range(28)]
        text = template[:100] + own + template[100:]
        rows.append((2 * i, " ".join(text)))
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join(edited(text, 2, i))))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for i, w in ((i, spaced(t)) for i, t in rows)}
    linked = {(i, j) for i, a in sets.items() for j, b in sets.items() if i < j and 100 * len(a & b) >= 85 * len(a | b)}
    assert linked and all(j == i + 1 for i, j in linked)
    assert got == {i: i - 1 if (i - 1, i) in linked else i for i in sets}


def test_decontamination(spark, docs):
    items = [(1, " ".join(words(60, 2)[5:40])), (2, "É é 1"), (3, None), (4, ""), (2, "É É É"), (5, " ".join(words(9, 99))), (None, " ".join(words(250, 6)[7:20])), (6, "w" * 5000)]
    bench = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, n_hit int")
    found = decontaminate.find_contamination(frame(spark, docs), bench)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect())
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    want = []
    for i, t in docs:
        w, hit, names = cut(t), set(), set()
        for name, text in items:
            v = cut(text)
            n = min(10, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j : j + n]) in grams:
                    hit.update(range(j, j + n))
                    names |= {str(name)} if name is not None else set()
        want.append((i is None, i or 0, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want) and any(x[-1] for x in want)


def test_url_rules(spark):
    r = random.Random(3)
    hosts = ["example.com", "www.example.com", "a.b.example.com", "EXAMPLE.com", "com", "x.net", "net", "badexample.com", "example.com.", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y", "/fr/é", "/EN/"]
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "") for h in hosts for p in paths for q in ("", "?a=/en/", "#/en/")] + [None, "", "nothing", "http://", "a://b://c"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("example.com", "/en/x", "allow"), ("net", "", "block"), ("example.com", "/en/", "allow"), (None, "/", "block"), ("e.com", "/en/", "allow")]
    pages = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[30])]
    r.shuffle(pages)
    df = spark.createDataFrame([(a, b, "x") for a, b in pages], "page_id long, url string, verdict string")
    got = sorted((x.page_id is None, x.page_id or 0, x.host, x.path, x.rule or "", x.verdict) for x in url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    want = []
    for i, u in pages:
        host = path = ""
        if u and "://" in u:
            raw = re.match(r"[^/?#]*", u.split("://", 1)[1]).group()
            path = re.match(r"[^?#]*", u.split("://", 1)[1][len(raw) :]).group()
            host = "".join(c.lower() if c.isascii() else c for c in raw)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and u is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, 0, "", "allow")
        want.append((i is None, i or 0, host, path, best[2], best[3]))
    assert got == sorted(want)
    empty = url_rules.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert empty.count() == 0
    assert {x.verdict for x in url_rules.judge(df, spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}


def test_warc_round_trip(spark):
    long = "é" * 700
    rows = [(1, "http://a/\r\nb", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "u", "x" * 3_000_000), (7, "u", "x" * 3_000_000), (8, "u", "WARC/1.1\r\n\r\n" * 200)]
    df = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, html string, digest string")
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        top = max((j for j, _, g in rows if g == h and j is not None), default=None)
        again = len(b) >= 1000 and top is not None and i != top
        want.append((i is None, i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=lambda x: x[:3])
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_normalised_members_stand_alone(tmp_path):
    data = [warc.record(i, "u", b"p" * i * 1000, hashlib.sha1(b"p" * i * 1000).hexdigest(), None, False) for i in range(5)]
    source = tmp_path / "whole.warc.gz"
    source.write_bytes(gzip.compress(b"".join(data[:3])) + gzip.compress(b"".join(data[3:])))
    archive, index, n = warc.normalise_file(f"file://{source}", f"file://{tmp_path}")
    raw = open(archive.removeprefix("file://"), "rb").read()
    lines = [x.split() for x in open(index.removeprefix("file://"))]
    assert n == 5 and [gzip.decompress(raw[int(o) : int(o) + int(m)]) for o, m, *_ in lines] == data
    assert gzip.decompress(raw) == b"".join(data)


def test_fingerprints(spark, docs):
    got = sorted(fingerprints.fingerprints_of_edits(frame(spark, docs)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert len(got) == len(docs)
    sh = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", t.lower()))
    by = {}
    for k, (r, (i, t)) in enumerate(zip(got, order)):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + nxt[:h]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(e.encode()).hexdigest())
        assert by.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == (256 if sh(t) else 0)
        for got_near, other in ((r.near_edited, e), (r.near_next, nxt)):
            a, b = sh(t), sh(other)
            true = len(a & b) / len(a | b) if a and b else float(not a and not b)
            assert abs(got_near - true) < 0.25
    assert fingerprints.fingerprints_of_edits(frame(spark, docs).limit(0)).count() == 0


def chained(*parts):
    """Spark's xxhash64 of several columns, as a signed number."""
    seed = 42
    for x in parts:
        seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else struct.pack("<i", x), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def samples(text):
    """The densified samples of a text, bin by bin."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    sh = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    least = {}
    for s in sh:
        h = chained(*s)
        b = (h & (1 << 64) - 1) >> 57
        least[b] = min(least.get(b, h), h)
    if not least:
        return []
    out = []
    for i in range(128):
        picks = [i, *(chained(i, t) % 128 for t in range(1, 13))]
        b = next((b for b in picks if b in least), None)
        out.append(least[b] & 255 if b is not None else min((chained(j, i), least[j] & 255) for j in least)[1])
    return out


def alike(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 128 - 2**-8) / (1 - 2**-8))


def test_fingerprints_bin_by_bin(spark, docs):
    got = sorted(fingerprints.fingerprints_of_edits(frame(spark, docs)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    order = sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    for k, (r, (_, t)) in enumerate(zip(got, order)):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, changed = samples(t), samples(e)
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{x:02x}" for x in s) for s in (own, changed))
        assert abs(r.near_edited - alike(own, changed)) < 1e-12 and abs(r.near_next - alike(own, samples(nxt))) < 1e-12
    by_id = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(frame(spark, [x for x in docs if x[0] not in (0, None)])).collect()}
    assert by_id == {i: "".join(f"{x:02x}" for x in samples(t or "")) for i, t in docs if i not in (0, None)}


@pytest.mark.parametrize("most", [1, 3, 8192])
def test_ordered_buckets_keep_their_size(spark, most):
    df = spark.range(0, 40000).selectExpr("id * id as k").unionByName(spark.createDataFrame([(None,), (4,), (4,)], "k long"))
    rows, n = ordered_buckets(df, "k", 500, most)
    got = sorted((r.k, r.bucket) for r in rows.collect() if r.k is not None)
    assert all(a[1] <= b[1] for a, b in zip(got, got[1:])) and {r.bucket for r in rows.where("k is null").collect()} == {-1}
    assert len({b for _, b in got}) > 40 and 0 <= got[0][1] and got[-1][1] < n


@pytest.fixture(scope="module")
def found():
    return pieces(queries.public_tokenizer("piece_bpe_32k.model"))


def scanned(found, text, size):
    """Score and ids of a text cut into chunks of `size` characters, and the chunks' matrices."""
    m = sentencepiece_scan.marked(text)
    cuts = [(m[max(0, k - found.most) : k], m[k : k + size], m[k + size : k + size + found.most]) for k in range(0, len(m), size)]
    matrices = [found.transfer(*c) for c in cuts]
    score, at = boundary_states(matrices)
    ids = [found.trace(b, c, a, found.states(b, c + a)[x], found.states(b + c, a)[y]) for (b, c, a), x, y in zip(cuts, at, at[1:])]
    return score, np.concatenate(ids).tolist(), matrices


@pytest.mark.parametrize("text", ["the cat sat on the mat " * 9, "abcabcabc" * 40, "   " * 30, "日本語" * 30, "x", "a b" * 60, "internationalization" * 12, "aaaa " * 20 + " ", "-=-=" * 40, " \t\n" * 20])
@pytest.mark.parametrize("size", [17, 20, 33, 64])
def test_scan_equals_the_library(found, text, size):
    score, ids, matrices = scanned(found, text, size)
    assert ids == found.library.encode(text) and score == found.scores[ids].sum()
    if len(matrices) > 2:
        left, right = combine(combine(*matrices[:2]), matrices[2]), combine(matrices[0], combine(*matrices[1:3]))
        assert np.array_equal(left, right)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text("abcdeiorst é日\n<", min_size=1, max_size=90), st.lists(st.sampled_from(["the", "ing", "al", "ation", " ", "  ", "ab", "日本"]), min_size=1, max_size=25).map("".join)), st.sampled_from([17, 29]))
def test_scan_of_any_text(found, text, size):
    assert scanned(found, text, size)[1] == found.library.encode(text)


def test_encode_and_decode_rows(spark, docs, found):
    long = " ".join(words(12000, 77))
    rows = [*docs, (2000, "word " * 20000), (2000, "word " * 20000), (2001, "▁ a"), (2002, "x" * 40000), (2003, long + "  " + long), (2004, " "), (2005, "  lead and trail   "), (2006, "Case case CASE"), (2007, "a" * 32767 + " b")]
    model = queries.public_tokenizer("piece_bpe_32k.model")
    got = sentencepiece_scan.encode(frame(spark, rows), model)
    all_rows = got.collect()
    for r in all_rows:
        texts = {t or "" for i, t in rows if i == r.doc_id}
        # the library's ids, whatever the length
        assert list(r.ids) in [found.library.encode(t) for t in texts] and r.n_tokens == len(r.ids)
        assert r.n_chars in {len(t) for t in texts} and abs(r.score - found.scores[list(r.ids)].sum()) <= 1e-6 * abs(r.score)
    assert len(all_rows) == len(rows)
    digest = sentencepiece_scan.encode(frame(spark, rows), model, digest=True)
    assert digest.where("not decoded").count() == 0
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in digest.collect()) == sorted((r.doc_id or 0, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in all_rows)
    back = {r.doc_id: r.text for r in sentencepiece_scan.decode(got, model).collect()}
    assert back[2001] == "  a" and back[2005] == "  lead and trail   " and back[2002] == "x" * 40000


def test_language_model_losses(spark):
    rows = [(1, "the cat sat on the mat"), (2, "the cat ran"), (3, "zebra zebra zebra"), (4, None), (5, ""), (2, "the cat ran"), (None, "the dog")]
    tok = queries.public_tokenizer("word_bpe_49k.json")
    got = {(r.doc_id, r.n_tokens): r for r in lm_scoring.score(frame(spark, rows), spark.createDataFrame([(1,), (2,), (None,)], "doc_id long"), tok, queries.WORD_VOCABULARY).collect()}
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(tok), queries.WORD_VOCABULARY
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]

    def model(which):
        uni, ctx, kinds, big = {}, {}, {}, {}
        for i, s in ids:
            if which(i):
                for h, w in zip([v, *s], s):
                    uni[w], ctx[h] = uni.get(w, 0) + 1, ctx.get(h, 0) + 1
                    kinds.setdefault(h, set()).add(w)
                    big[h, w] = big.get((h, w), 0) + 1
        n = sum(uni.values())

        def loss(s):
            out = 0.0
            for h, w in zip([v, *s], s):
                p = (uni.get(w, 0) + 0.5) / (n + 0.5 * v)
                if h in ctx:
                    p = (max(big.get((h, w), 0) - 0.75, 0) + 0.75 * len(kinds[h]) * p) / ctx[h]
                out -= np.log2(p)
            return out / len(s)

        return loss

    target, background = model(lambda i: i in (1, 2)), model(lambda i: True)
    for i, s in ids:
        r = got[i, len(s)]
        if s:
            assert abs(r.target_loss - target(s)) < 1e-9 and abs(r.background_loss - background(s)) < 1e-9
        else:
            assert r.difference is None
    assert got[3, len(dict(ids)[3])].difference > got[1, len(dict(ids)[1])].difference


def test_language_identification(spark):
    r = random.Random(1)
    parts = {"aa": ["the", "ing", "wh", "tion"], "bb": ["ñ", "ción", "rr", "el"], "cc": ["ß", "sch", "ü", "ein"]}
    rows = [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randint(5, 60))), lang) for i in range(300) for lang in [r.choice(list(parts))]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !!", "bb"), (None, rows[0][1], "aa"), (1003, rows[1][1], None)]
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, lang string, score string")
    got = language_id.identify(df).collect()
    truth = {i: lang for i, _, lang in rows}
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1
        if x.doc_id in (1000, 1001, 1002):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in got if x.held_out and x.doc_id is not None and x.doc_id < 1000]) > 0.97
    none = language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in none} == {"und"}


def test_language_sample_is_of_distinct_texts(spark, monkeypatch):
    r = random.Random(4)
    own = {"aa": "the ing wh tion".split(), "bb": "xo xu xi xa".split()}
    text = lambda lang: " ".join("".join(r.choice(own[lang]) for _ in range(3)) for _ in range(20))
    hot = text("aa")
    rows = [(i, hot, "aa") for i in range(3000)] + [(4000 + i, text(lang), lang) for i in range(120) for lang in own]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 50)
    to_arrow = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: seen.append(to_arrow(self)) or seen[-1])
    model = language_id.fit(df)
    langs = seen[0].column("lang").to_pylist()
    assert langs.count("bb") == 50 and langs.count("aa") == 50 and len(set(seen[0].column("key").to_pylist())) == 100
    fresh = spark.createDataFrame([(i, text(lang)) for i in range(20) for lang in own], "doc_id long, text string")
    got = [x.lang_pred for x in language_id.predict(fresh, model).collect()]
    assert got == list(own) * 20
    monkeypatch.setattr(language_id, "SAMPLE", language_id.LEAST_SAMPLE)
    with pytest.raises(ValueError, match="labels"):
        language_id.fit(df)


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    rows = [*docs, (3000, "It's <|endoftext|> <|ENDOFTEXT|> reed&&& x_y É.é\x1c\u2003z ..word.. 3.5 don't!!"), (3001, "e\u0301 \u0301a Σ ΑΣ")]
    tok = queries.public_tokenizer("word_bpe_49k.json")
    got = token_files.token_file_round_trip(frame(spark, rows), tok, queries.WORD_VOCABULARY).collect()
    t, at, want = Tokenizer.from_file(tok), 0, []
    for i, x in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda x: x[1]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == want


def test_token_file_ranges(tmp_path):
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 1, 70_000, 65_536, 5, 200_000)]
    w = token_files.Writer(f"file://{tmp_path}/a.bin", 17)
    for i, p in enumerate(parts):
        w.add(i if i else None, p)
    w.close()
    r, flat = token_files.Reader(f"file://{tmp_path}/a.bin"), np.concatenate(parts)
    for start, n in ((0, len(flat)), (65_535, 3), (131_070, 70_000), (len(flat) - 1, 1), (7, 0)):
        assert r.ids(start, n).tolist() == flat[start : start + n].tolist()
    assert r.counts.tolist() == [len(p) for p in parts] and r.known.tolist() == [0, 1, 1, 1, 1, 1]


def test_repeated_passages(spark, docs):
    near = words(60, 2)
    near[30] = "changed"
    rows = [*docs, (5000, " ".join(words(80, 30) + near + words(80, 31)))]
    got = {}
    for r in substring_dedup.repeated_passages(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, spaced(t))
    seen = {}
    for i, w in texts.items():
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), set()).add(i if i is not None else -1)
    for i, w in texts.items():
        if i is None:
            assert got[i].class_id is None
            continue
        cover, later = set(), set()
        for j in range(len(w) - 49):
            s = seen[tuple(w[j : j + 50])] - {-1}
            cover |= set(range(j, j + 50)) if len(s) > 1 else set()
            later |= set(range(j, j + 50)) if min(s) < i else set()
        spans = {k for s in got[i].spans or [] for k in range(s["first"], s["end"])}
        assert later <= spans and got[i].n_repeated >= len(cover) and got[i].repeated == bool(got[i].n_repeated)
        assert got[i].n_words == len(w)
    assert got[5000].repeated and got[5000].n_removed >= 45  # a near-duplicate passage
    assert not any(got[i].repeated for i in (160, 170, 190, 1000, 1001, 1003, 1004, 1005, 1007))
    assert substring_dedup.repeated_passages(frame(spark, rows).limit(0)).count() == 0


def repeats(spark, texts):
    return {r.doc_id: r for r in substring_dedup.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in texts.items()])).collect()}


def removed(row):
    return [(s["first"], s["end"]) for s in row.spans or []]


def test_passage_twice_in_a_document(spark):
    p, near, follows = words(60, 50), words(60, 50), words(40, 51)
    near[30] = "changed"
    texts = {1: p, 2: p + words(70, 52) + p, 3: words(9, 53) + near + words(70, 54) + near}
    texts |= {11: words(60, 55) + words(30, 56) + words(60, 55) + follows, 12: words(60, 55) + follows}
    got = repeats(spark, texts)
    assert removed(got[2]) == [(0, 60), (130, 190)] and got[2].n_repeated == 120
    assert removed(got[3]) == [(9, 69), (139, 199)]
    assert removed(got[12]) == [(0, 100)] and got[11].n_repeated == 160 and not removed(got[11])


def test_equal_passages_under_a_common_line(spark):
    own = lambda i, n: [f"own{i}and{k}" for k in range(n)]
    texts = {}
    for k in range(300):
        line = own(k, 49)
        # the last two of four documents go on with the same six words
        texts |= {4 * k + j: own(f"a{k}a{j}", 8) + line + own(f"b{k}b{min(j, 2)}", 6) + own(f"c{k}c{j}", 9) for j in range(4)}
    got = repeats(spark, texts)
    assert {i: removed(r) for i, r in got.items() if r.spans} == {i: [(8, 63)] for i in texts if i % 4 == 3}
    assert {i for i, r in got.items() if r.repeated} == {i for i in texts if i % 4 > 1}
    # whatever keys two documents share, also where the first of them has part of the passage
    rng = np.random.default_rng(5)
    pool = [words(26, 400 + k) for k in range(6)]
    texts = {i: sum((pool[k] for k in rng.integers(0, 6, 4)), []) for i in range(1, 60)}
    got, seen = repeats(spark, texts), {}
    for i, w in texts.items():
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), []).append(i)
    for i, w in texts.items():
        own = [(j, seen[tuple(w[j : j + 50])]) for j in range(len(w) - 49)]
        assert {k for j, s in own if s[0] < i for k in range(j, j + 50)} <= {k for x, y in removed(got[i]) for k in range(x, y)}
        assert got[i].n_repeated >= len({k for j, s in own if len(set(s)) > 1 for k in range(j, j + 50)})


def test_near_passages_of_four_fifths(spark):
    own = lambda i, n: [f"own{i}and{k}" for k in range(n)]
    texts = {}
    for k in range(300):
        p = own(k, 60)
        # 51 of 61 shingles are alike
        texts |= {2 * k: own(f"a{k}", 9) + p, 2 * k + 1: own(f"b{k}", 9) + [f"c{w}" if j == 30 else w for j, w in enumerate(p)] + own(f"d{k}", 9)}
    got = repeats(spark, texts)
    assert all(removed(got[i]) == ([(9, 69)] if i % 2 else []) and got[i].repeated for i in texts)
    # the longest stretch is not alike, a shorter one is
    p1, p2 = own("e", 60), own("f", 80)
    got = repeats(spark, {1: [*p1[:30], "changed", *p1[31:]] + own("g", 80) + p2, 2: p1 + p2})
    assert sum(y - x for x, y in removed(got[2])) == 140


def test_recall_of_near_passages_against_all_pairs(spark):
    # families of passages with words changed at random, so that some are like each other and unlike the first
    rng, texts = random.Random(11), {}
    for k in range(60):
        base = [f"own{k}x{j}" for j in range(rng.choice([55, 70, 90, 140]))]
        for v in range(4):
            p = list(base)
            for j in rng.sample(range(len(p)), max(1, len(p) // 35)):
                p[j] = f"new{rng.randrange(10**9)}"
            pad = lambda n: [f"pad{rng.randrange(10**9)}" for _ in range(n)]
            texts[10 * k + v] = pad(rng.randrange(40)) + p + pad(rng.randrange(40))
    got = repeats(spark, texts)

    def shingles(w):
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        words_, at = K.hash_words(data, np.array([0, len(data)]), K.SPACED)
        return K.shingle_hashes(words_, at, 5)[0]

    sh, links = {i: shingles(w) for i, w in texts.items()}, set()
    for i in texts:
        for j in range(i + 1, i // 10 * 10 + 4):  # no others share a word
            if substring_dedup.compare([sh[i], sh[j]], np.array([0, 0]), False)[0]:
                links.add((i, j))
    assert len(links) > 100
    found = sum(got[i].class_id == got[j].class_id for i, j in links)
    assert found >= 0.9 * len(links), found / len(links)
    print("recall", found, len(links))
    # and nothing else is linked
    assert all((got[i].class_id // 10 == i // 10) and (got[i].repeated == any(i in x for x in links) or not got[i].repeated) for i in texts)


@pytest.mark.parametrize("period", [1, 2, 3, 97])
def test_periodic_texts_stay_small(spark, period):
    own = [f"p{k % period}" for k in range(100_000)]
    got = repeats(spark, {1: own, 2: own[7:60_000] + words(70, 90), 3: words(80, 91)})
    assert got[2].n_removed >= 59_993 - 5 and got[1].n_repeated == 100_000 and not got[3].repeated


def test_empty_tables(spark, docs):
    none = frame(spark, docs).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0
    assert language_id.identify(none.withColumn("lang", F.lit("x"))).count() == 0
    assert fingerprints.fingerprint(none).count() == 0 and warc.archive_round_trip(none.selectExpr("doc_id as page_id", "text as url", "text as html")).count() == 0
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(frame(spark, docs), bench).where("contaminated").count() == 0
    assert sentencepiece_scan.encode(none, queries.public_tokenizer("piece_bpe_32k.model")).count() == 0
    tok = queries.public_tokenizer("word_bpe_49k.json")
    assert token_files.token_file_round_trip(none, tok, queries.WORD_VOCABULARY).count() == 0
    assert lm_scoring.score(none, spark.createDataFrame([], "doc_id long"), tok, queries.WORD_VOCABULARY).count() == 0


def test_inflating_keeps_every_byte():
    data = bytes(range(256)) * 5000
    assert b"".join(warc.inflated(io.BytesIO(gzip.compress(data)))) == data
