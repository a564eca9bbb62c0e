"""URL filters: rules by host and path, and trust and distrust propagated over the links between hosts.

Hosts with pages that rules allow are trusted seeds, those with pages that rules block are blocked seeds, both weighted by
how many of the pages of all seeds they have. Trust is the personalised PageRank from the trusted seeds along links
between hosts, distrust that from the blocked seeds along reversed links. A host is blocked when its distrust is at least
``floor`` times that of a single blocked page's seed and more than ``margin`` times its trust; that judges the pages no
rule fits. The rounds go on until no host's score moves by ``tolerance`` times the share of a single seed page. Both are
shares of a page, so neither depends on how many pages or hosts a table has.

Rules are joined to hosts by the hosts' suffixes, links are reduced to weighted host edges before anything is iterated,
and each round is one join and one aggregation over the hosts, written to a table. Pages meet the verdicts of their hosts
in a join that carries no hint, so a hot host is split like any skewed key.

Null urls and those without ``://`` have an empty host and path, no links and no rule; they are allowed, as are hosts
that no seed reaches. Null pages have no links. Repeated rows each get their row, links of one host to another count once;
empty tables give no rows; columns other than those named are not read. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebeat.llm.support import narrow, stage, table

RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and its rules as an array of (length, rule, path, action), longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = hosts.filter("host <> ''").select("host", F.explode(suffixes).alias("suffix"))
    fitting = named.join(rules, named.suffix == rules.rule_host)
    rule = F.struct(F.length("rule").alias("length"), "rule", "rule_path", "action")
    return fitting.groupBy("host").agg(F.sort_array(F.collect_set(rule), asc=False).alias("rules"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float, rounds: int | None, store) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind of edges (kind, a, b) from its seeds (kind, host, seed).

    What hosts without edges hold goes back to the seeds. Scores of a kind add up to 1. The rounds end when no score, times
    the total of its kind's seeds, moves by ``tolerance``, or after ``rounds``. Without a number of rounds there are as many
    as that can take: all moves of a kind together are 2 at most and shrink by ``damping`` a round.
    """
    shares = edges.groupBy("kind", "a").agg(F.count(F.lit(1)).alias("n"))
    edges = store.write("edges", edges.join(shares, ["kind", "a"]).select("kind", "a", "b", (1 / F.col("n")).alias("share")))
    totals = store.write("totals", seeds.groupBy("kind").agg(F.sum("seed").alias("total")))
    seeds = store.write("seeds", seeds.join(totals, "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("seed")))
    scores = seeds.withColumnRenamed("seed", "score")
    if rounds is None:
        rounds = math.ceil(math.log(tolerance / (2 * (totals.agg(F.max("total")).first()[0] or 1.0))) / math.log(damping))
    for turn in range(rounds):
        moved = scores.join(edges, (scores.kind == edges.kind) & (scores.host == edges.a)).select(edges.kind, F.col("b").alias("host"), (damping * F.col("score") * F.col("share")).alias("part"))
        given = moved.groupBy("kind").agg(F.sum("part").alias("given"))
        back = seeds.join(given, "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("given", F.lit(0.0)))).alias("part"))
        step = moved.unionByName(back).groupBy("kind", "host").agg(F.sum("part").alias("score"))
        new = store.write(f"scores-{turn}", step)
        old = scores.toDF("kind", "host", "old")
        moves = new.join(old, ["kind", "host"], "full").select("kind", F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("move"))
        moves = moves.groupBy("kind").agg(F.max("move").alias("move"))
        gap = moves.join(totals, "kind").agg(F.max(F.col("move") * F.col("total")).alias("gap")).first()["gap"]
        scores = new
        if not gap or gap < tolerance:
            break
    return scores


def url_filters(
    frame: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    rules: tuple[tuple[str, str], ...] = RULES,
    damping: float = 0.85,
    tolerance: float = 1e-6,
    rounds: int | None = None,
    margin: float = 2.0,
    floor: float = 1e-6,
) -> DataFrame:
    """id, host, path, rule and verdict of every page, and its host's trust and distrust.

    rules: (host and path, allow or block); a rule fits its host and all subdomains where the path begins with the
    rule's, and the longest counts.
    """
    spark = frame.sparkSession
    store = stage(spark)
    pages = narrow(frame, id=id_column, url=url_column, html=html_column)
    host, path = host_and_path(F.col("url"))
    pages = pages.select("id", host.alias("host"), path.alias("path"), F.transform(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))), lambda x: F.translate(x, UPPER, LOWER)).alias("links"))
    pages = store.write("pages", pages)
    listed = spark.createDataFrame([(rule.split("/", 1)[0], "/" + rule.split("/", 1)[1], rule, action) for rule, action in rules], "rule_host string, rule_path string, rule string, action string")
    counts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    of_host = store.write("rules", rules_of_hosts(counts, listed))
    first = F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"]))
    judged = pages.select("id", "host", "path").join(of_host, "host", "left").withColumn("fits", F.try_element_at(first, F.lit(1)))
    judged = store.write("judged", judged.select("id", "host", "path", F.col("fits.rule").alias("rule"), F.col("fits.action").alias("action")))
    kind = F.when(F.col("action") == "allow", "trust").otherwise("distrust").alias("kind")
    seeds = judged.filter("action is not null").groupBy(kind, "host").agg(F.count(F.lit(1)).cast("double").alias("seed"))
    pairs = pages.filter("host <> ''").select(F.col("host").alias("a"), F.explode("links").alias("b")).filter("b <> '' and a <> b").distinct()
    pairs = store.write("pairs", pairs)
    edges = pairs.select(F.lit("trust").alias("kind"), "a", "b").union(pairs.select(F.lit("distrust"), "b", "a"))
    page = seeds.filter("kind = 'distrust'").agg(F.sum("seed")).first()[0] or 1.0
    scores = propagate(edges, seeds, damping, tolerance, rounds, store)
    hosts = scores.groupBy("host").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    hosts = store.write("hosts", hosts)
    found = judged.join(hosts, "host", "left")
    trust, distrust = (F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust"))
    blocked = (distrust * page >= floor) & (distrust > margin * trust)
    verdict = F.coalesce("action", F.when(blocked, "block").otherwise("allow"))
    return found.select(F.col("id").alias(id_column), "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_filters(table(spark, sf_dir, "pages"))
