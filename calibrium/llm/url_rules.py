"""URL rules as a sort-merge range join, in DataFrame operations alone (op3).

A canonical key is the host with its labels reversed, `)` and the path, as in
`com,example,www)/en/`. A rule's key is a prefix of the keys it covers, so a
rule is an interval of the sorted keys, and intervals of one host are nested or
disjoint. Since a rule also covers subdomains, a url has one key for itself and
one for each parent host that has rules at all.

The sweep sorts rules and url keys together. A rule carries the stack of rules
open at its place (itself and the rules that enclose it); a key takes the stack
of the last rule before it and drops the rules that have ended. What is left on
top is the longest rule of that host. A host with very many urls is swept in
several parts, each with the host's rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys swept together, and how many times as many keys as rules, at least.
SWEEP, OVER_RULES = 512, 4
#: Hosts with rules whose numbers of parts are sent to every task; beyond it they are joined by a shuffle.
SENT = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ",")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict), a row per row of `pages`.

    rules: (host, path, verdict). The longest fitting rule wins, by the length
    of host and path together, then of the host; of equal rules a block goes
    before an allow. No rule fits: rule null, verdict `default`. A url that is
    null or has no `://` has empty host and path and fits no rule of a host.
    Repeated rows are judged alike. No rules: all are `default`. Other columns
    are not read.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rules = rules.where("host is not null and path is not null").groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(_reversed(F.col("host")).alias("at"), "path", F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"))

    # The stack at each rule's place: all rules of its host whose path begins its path.
    begins = rules.select("at", F.col("path").alias("inner"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))).alias("path"))
    entry = F.struct(F.length("path").alias("n"), "path", "rule", "verdict", "host_length")
    stacks = begins.join(rules, ["at", "path"]).groupBy("at", F.col("inner").alias("path")).agg(F.array_sort(F.collect_list(entry)).alias("stack"))

    host, path = host_and_path(F.col("url"))
    urls = pages.where("url is not null").select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    labels = F.reverse(F.split("host", r"\."))
    keys = urls.select("url", "path", labels.alias("labels")).select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.array_join(F.slice("labels", F.lit(1), n), ","))).alias("at"))
    # Counted before any join, so that a host's keys are summed where they are read.
    hosts = rules.groupBy("at").agg(F.count("*").alias("n_rules"))
    counts = keys.groupBy("at").agg(F.count("*").alias("n"))
    parts = counts.join(hosts, "at").select("at", F.ceil(F.col("n") / F.greatest(F.lit(SWEEP), F.lit(OVER_RULES) * F.col("n_rules"))).cast("int").alias("parts"))

    few = hosts.limit(SENT + 1).count() <= SENT
    dealt = keys.join(F.broadcast(parts) if few else parts, "at").select("at", F.pmod(F.xxhash64("url"), F.col("parts")).cast("int").alias("part"), F.concat("at", F.lit(")"), "path").alias("key"), F.lit(1).alias("kind"), "url", "path", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    opened = stacks.join(parts, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.concat("at", F.lit(")"), "path").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), "path", "stack")
    sweep = Window.partitionBy("at", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # by both: dealt by the host alone, all parts of a host would meet in one task
    swept = dealt.union(opened).repartition("at", "part").withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1 and open is not null")
    top = F.try_element_at(F.filter("open", lambda r: F.col("path").startswith(r["path"])), F.lit(-1))
    fits = swept.select("url", top.alias("top")).where("top is not null")
    best = fits.groupBy("url").agg(F.max(F.struct((F.col("top.n") + F.col("top.host_length")).alias("long"), F.col("top.host_length").alias("of_host"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best"))
    return pages.join(best, "url", "left").select("page_id", "url", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
