"""Scans, sources and sinks (IO*) on files that a query writes to the session's own folder."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import numeric as N
from ..sources import readers, store, strict_json
from ..streaming import resume
from . import query
from .scalars import r9


def _folder(spark) -> str:
    return store.shared_folder(spark, "io")


@query("io01_read_json_lines", "SELECT doc_id, lang, n_chars, sha256(text) AS text_sha256 FROM documents")
def io01(spark, d):
    path = _folder(spark)
    X.table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text").write.json(path)
    rows = readers.read_json_lines(spark, path, "doc_id long, lang string, n_chars long, text string")
    return rows.select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query("io02_load_records", "SELECT conv_id, turn, role FROM conversations")
def io02(spark, d):
    path = _folder(spark)
    X.table(spark, d, "conversations").select("conv_id", "turn", "role").write.json(path)
    return readers.read_json_lines(spark, path, "conv_id long, turn long, role string")


@query("io03_load_case_set", f"WITH {X.F5} SELECT case_id, CAST(avg(rung) AS DOUBLE) AS mean FROM (SELECT DISTINCT case_id, rung FROM f5) GROUP BY case_id")
def io03(spark, d):
    path = _folder(spark)
    f5 = X.ladder_records(spark, d).select("case_id", "rung").distinct().groupBy("case_id").agg(F.sort_array(F.collect_list("rung")).alias("rungs"))
    # one document: a case set is a small file
    f5.agg(F.collect_list(F.struct("case_id", "rungs")).alias("cases")).write.json(path)
    cases = readers.read_case_file(spark, path, "cases array<struct<case_id: long, rungs: array<int>>>", "cases")
    return cases.select("case_id", (F.aggregate("rungs", F.lit(0), lambda s, x: s + x) / F.size("rungs")).alias("mean"))


@query("io04_read_rows", "SELECT p_partkey, p_name FROM part")
def io04(spark, d):
    return readers.read_shards(spark, f"{d}/part.parquet", ["p_partkey", "p_name"])


@query("io05_read_tar_csv", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def io05(spark, d):
    rows = X.table(spark, d, "nation").select("n_name", F.col("n_regionkey").cast("string")).collect()
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as tar:
        body = "".join(f'"{a}",{b}\n' for a, b in rows).encode()
        info = tarfile.TarInfo("test/nation.csv")
        info.size = len(body)
        tar.addfile(info, io.BytesIO(body))
    path = _folder(spark)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/nation.tar")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(data.getvalue()))
    out.close()
    return readers.read_tar_csv(spark, path, ["name", "region"]).select("name", "region")


#: Fixed texts.
TEXTS = [(0, '{"a":1}', None), (1, '{"a":1,"a":2}', "repeated key"), (2, '{"a":NaN}', "NaN is no number"), (3, "[1]", "not an object"), (4, "{", "not JSON"), (5, "[" * 65 + "]" * 65, "too deep"), (6, '{"a":"[[[\\"{"}', None), (7, None, "null"), (8, '{"a":1e999}', "1e999 is no number"), (9, '{"a":-1e400}', "-1e400 is no number"), (10, '{"a":' + "7" * 5000 + "}", "too many digits"), (11, '{"a":1e308}', None), (12, '{"a":' * 64 + "1" + "}" * 64, "too deep"), (13, '{"a":' * 64 + "{}" + "}" * 64, "too deep"), (14, '{"a":' * 63 + "{}" + "}" * 63, None)]


@query("io06_strict_json", "SELECT * FROM (VALUES " + ", ".join(f"({i}, " + (f"'{r}'" if r else "NULL") + ")" for i, _, r in TEXTS) + ") AS t(id, reason)")
def io06(spark, d):
    rows = spark.createDataFrame([(i, t) for i, t, _ in TEXTS], "id int, text string")
    return strict_json.checked(rows, "text").select("id", "reason")


@query("io07_bounded_nesting", "SELECT * FROM (VALUES (1, true), (64, true), (65, false)) AS t(depth, allowed)")
def io07(spark, d):
    rows = spark.createDataFrame([(n, "{" + '"a":{' * (n - 1) + "}" * n) for n in (1, 64, 65)], "depth int, text string")
    return strict_json.checked(rows, "text").select("depth", F.col("reason").isNull().alias("allowed"))


#: Canonical text of a nation's artefact in SQL.
_ARTEFACT = """'{"domain":' || n_regionkey || ',"name":"' || n_name || '","v":1}'"""


def _artefacts(spark, d):
    """Small artefacts, one of every nation: a driver's number of them."""
    return {r.n_nationkey: {"v": 1, "name": r.n_name, "domain": int(r.n_regionkey)} for r in X.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()}


@query("io08_store_put", f"SELECT n_nationkey, sha256({_ARTEFACT}) AS fp, true AS again, substr(sha256({_ARTEFACT}), 1, 2) AS shard FROM nation")
def io08(spark, d):
    s = store.ArtefactStore(spark, _folder(spark))
    rows = [(k, s.put(a), s.put(dict(reversed(a.items())))) for k, a in _artefacts(spark, d).items()]
    shards = set(s.files.names(f"{s.folder}/v1"))
    return spark.createDataFrame([(k, fp, fp == other, next(x for x in shards if fp.startswith(x))) for k, fp, other in rows], "n_nationkey long, fp string, again boolean, shard string")


@query("io09_store_get", f"SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_name END AS name, CASE n_regionkey WHEN 0 THEN 'its content has another fingerprint' WHEN 1 THEN 'read' ELSE 'read' END AS state FROM nation UNION ALL SELECT -1, NULL, 'absent'")
def io09(spark, d):
    """Every artefact read back; those of the first region are changed behind the store's back."""
    s = store.ArtefactStore(spark, _folder(spark))
    out = []
    for k, a in _artefacts(spark, d).items():
        fp = s.put(a)
        if a["domain"] == 0:
            s.files.publish(s.path(fp), '{"v":1,"name":"other","domain":0}')
        state = s.told(fp)
        out.append((k, s.get(fp)["name"] if state == "read" else None, state))
    return spark.createDataFrame([*out, (-1, None, s.told("0" * 64))], "n_nationkey long, name string, state string")


@query("io10_catalog_store", f"SELECT r_regionkey, sha256('{{\"members\":[' || string_agg('\"' || sha256({_ARTEFACT}) || '\"', ',' ORDER BY sha256({_ARTEFACT})) || '],\"v\":1}}') AS fp, count(*) AS members FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def io10(spark, d):
    """A snapshot of each region's artefacts, stored and read back."""
    s = store.ArtefactStore(spark, _folder(spark))
    by: dict[int, list[str]] = {}
    for a in _artefacts(spark, d).values():
        by.setdefault(a["domain"], []).append(store.fingerprint(a))
    fps = {r: s.put({"v": 1, "members": sorted(m)}) for r, m in by.items()}
    return spark.createDataFrame([(r, fp, len(s.get(fp)["members"])) for r, fp in fps.items()], "r_regionkey long, fp string, members long")


@query("io11_publish_atomically", "SELECT r_regionkey, r_name AS content, CAST((SELECT count(*) FROM region) AS BIGINT) AS files FROM region")
def io11(spark, d):
    """Each region's text published over an older one; no file of an attempt is left."""
    files, folder = store.Files(spark), _folder(spark)
    regions = X.table(spark, d, "region").select("r_regionkey", "r_name").collect()
    for text in ("older", None):
        for r in regions:
            files.publish(f"{folder}/{r.r_regionkey}.txt", text or r.r_name)
    n = len([x for x in files.names(folder) if not x.startswith(".") or x.startswith(".new-")])
    return spark.createDataFrame([(r.r_regionkey, files.read(f"{folder}/{r.r_regionkey}.txt"), n) for r in regions], "r_regionkey long, content string, files long")


@query("io12_commit_rows", "SELECT count(*) AS n FROM (SELECT DISTINCT event_id FROM events)")
def io12(spark, d):
    path = _folder(spark)
    n = 0
    for _ in range(2):  # the second run finds all rows committed
        n = resume.commit_stream(spark, _copied(spark, d, path), "event_id long, event_type string", f"{path}/out", f"{path}/state", "event_id")
    return spark.createDataFrame([(n,)], "n long")


def _copied(spark, d, path):
    """A streaming source is a folder; a single file is written to one."""
    X.table(spark, d, "events").select("event_id", "event_type").write.mode("ignore").parquet(f"{path}/in")
    return f"{path}/in"


@query("io13_committed_rows", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def io13(spark, d):
    return resume.repeated(X.table(spark, d, "conversations"), "conv_id").select("conv_id", F.col("count").alias("n"))


@query("io14_profile_text", f"SELECT n_nationkey, {_ARTEFACT} AS text, sha256({_ARTEFACT}) AS fp, 'not JSON' AS cut FROM nation")
def io14(spark, d):
    """Artefacts to canonical text and back, and the text without its end refused."""
    from ..functions.identity import canonical_json

    texts = {k: canonical_json(a) for k, a in _artefacts(spark, d).items()}
    return spark.createDataFrame([(k, canonical_json(strict_json.parse(t)), store.fingerprint(strict_json.parse(t)), strict_json.reason(t[:-1])) for k, t in texts.items()], "n_nationkey long, text string, fp string, cut string")


@query("io15_catalog_text", f"SELECT r_regionkey, '{{\"members\":[' || string_agg('\"' || sha256({_ARTEFACT}) || '\"', ',' ORDER BY sha256({_ARTEFACT})) || '],\"v\":1}}' AS text, 'repeated key' AS doubled FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def io15(spark, d):
    from ..functions.identity import canonical_json

    by: dict[int, list[str]] = {}
    for a in _artefacts(spark, d).values():
        by.setdefault(a["domain"], []).append(store.fingerprint(a))
    texts = {r: canonical_json({"v": 1, "members": sorted(m)}) for r, m in by.items()}
    return spark.createDataFrame([(r, canonical_json(strict_json.parse(t)), strict_json.reason('{"v":1,' + t[1:])) for r, t in texts.items()], "r_regionkey long, text string, doubled string")


@query("io16_evidence_file", f"""WITH {X.S1} SELECT item_id, CASE WHEN truth IS NULL THEN 'no truth' WHEN status = 'TAXONOMY_MISS' THEN 'truth is no candidate' WHEN selected_p < 0.2 THEN 'nearly even' ELSE 'ok' END AS verdict, sha256('{{"item":' || item_id || ',"v":1,"winner":"' || winner || '"}}') AS seal FROM s1""")
def io16(spark, d):
    """Evidence written with a seal a row, read back, its seals recomputed and its rows judged."""
    from ..functions import identity as I
    from ..operators.scoring import first_violation
    from .scoring import observed

    seal = lambda: I.digest(I.record_text({"item": F.col("item_id"), "winner": I.quoted(F.col("winner")), "v": F.lit(1)}))
    path = _folder(spark)
    observed(spark, d).select("item_id", "winner", "status", "truth", "selected_p", seal().alias("seal")).write.json(path)
    back = readers.read_json_lines(spark, path, "item_id long, winner string, status string, truth string, selected_p double, seal string").withColumn("own", seal())
    rules = [("broken seal", "seal <> own"), ("no truth", "truth is null"), ("truth is no candidate", "status = 'TAXONOMY_MISS'"), ("nearly even", "selected_p < 0.2")]
    return back.select("item_id", first_violation(rules).alias("verdict"), "seal")


@query("io17_evidence_source", f"WITH {X.F1} SELECT item_id, sha256('plan' || item_id % 8) AS plan_fp, round(v[1 + item_id % 8], 9) AS first_logit, round(v[1 + (item_id + 7) % 8], 9) AS last_logit FROM f1")
def io17(spark, d):
    """The boundary where a model's forward pass would be: a plan asks for labels in its own order, a table of logits answers."""
    from ..functions import identity as I
    from ..sources.evidence import answer

    logits = X.choice_evidence(spark, d).select("item_id", F.map_from_arrays("labels", "values").alias("logits"))
    turn = (F.col("item_id") % 8).cast("int")
    order = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.get(F.array(*map(F.lit, X.LABELS)), F.pmod(k + turn, F.lit(8)).cast("int")))
    plans = X.choice_evidence(spark, d).select("item_id", order.alias("labels"), I.digest(F.concat(F.lit("plan"), turn.cast("string"))).alias("plan_fp"))
    e = answer(plans, logits, "item_id")
    return e.select("item_id", "plan_fp", r9(F.get("values", F.lit(0)), "first_logit"), r9(F.element_at("values", -1), "last_logit"))


@query("io18_checkpoint_blocks", f"WITH {X.F3} SELECT CAST(item_id % 8 AS VARCHAR) AS block, CASE WHEN item_id % 8 < 3 THEN 1 ELSE 2 END AS run, count(*) AS n, round(avg(cat_score), 9) AS mean FROM f3 GROUP BY ALL")
def io18(spark, d):
    """Eight blocks, of which a first run does three; the second goes on with the others."""
    from ..streaming.blocks import BlockStore

    rows, done = X.paired_rows(spark, d), BlockStore(spark, _folder(spark))
    for run, blocks in ((1, range(3)), (2, range(8))):
        done.run(map(str, blocks), lambda b, run=run: rows.where(F.col("item_id") % 8 == int(b)).agg(F.lit(b).alias("block"), F.lit(run).alias("run"), F.count("*").alias("n"), r9(F.avg("cat_score"), "mean")))
    return done.rows()


@query("ext_stream_windows", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def ext_stream(spark, d):
    """An extension: events by type as a stream, counted once each."""
    path = _folder(spark)
    src = _copied(spark, d, path)
    stream = spark.readStream.schema("event_id long, event_type string").parquet(src).groupBy("event_type").count()
    name = f"calibrium_stream_{abs(hash(path))}"
    stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query("fi_score_state", "SELECT 'FINITE' AS state")
def fi_state(spark, d):
    return spark.range(1).select(N.state(F.lit(1.5)).alias("state"))
