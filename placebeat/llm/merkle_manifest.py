"""A Merkle manifest of a table: a tree of SHA-256 digests over its rows, group by group, with a proof for every row.

A row's coordinate is its rank by id within its group. Ids are put into bitmaps, 512 ids to a container, a container for each
group and stretch of ids that has any; tasks merge their own bits first, containers are merged after the shuffle. A
directory of counts over containers, in steps of 4,096 siblings, gives the number of rows before a container; the bits below
an id's own give the rest. So no group is sorted or held in one task, however its ids are spread.

Nodes are reduced by keyed slots: 512 consecutive coordinates make a block, whose array of slots gives three levels of the
tree in place; its top is a node of the next, 512 times smaller table. Paths come down the same blocks: a block's own path is
joined to it once, and a row's is put together from its block's levels. DataFrame operations only; the driver gets the root,
the largest number of blocks and of siblings, and whether there are ties.

Groups are ordered by their UTF-8 bytes, null first. Rows with a null id come before the others of their group. Rows with
equal ids follow each other in the order of their leaves, equal rows among them in any order, each with its own coordinate;
containers that hold ties are found by their counts, and only their tied rows are put in order, in ranges that no id or group
has to share. Null values count as ``-``; texts of any length are digested in place; an empty table gives no rows; columns
other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placebeat.llm.mixing import with_rank
from placebeat.llm.support import stage, table
from placebeat.plans.stage import Stage

FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
ID_BITS, WORDS = 9, 8  # of a container: 512 ids, 8 words of 64 bits
STEP_BITS = 12
NULL_ID = -(1 << 54) - 1  # the container of null ids, before all others
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(values: Sequence[Column]) -> Column:
    """SHA-256 of values: each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text)), 256)


def word(k: int) -> Column:
    return F.col(f"word{k}")


def containers(rows: DataFrame) -> DataFrame:
    """key, high, n (rows), ids (distinct ones) and the bitmap's words, of rows with key, high and low."""
    bit = F.expr("shiftleft(1L, low & 63)")
    merged = rows.groupBy("key", "high").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.bit_or(F.when(F.shiftright("low", 6) == k, bit)), F.lit(0)).cast("long").alias(f"word{k}") for k in range(WORDS)))
    return merged.withColumn("ids", sum((F.bit_count(word(k)) for k in range(1, WORDS)), F.bit_count(word(0))))


def with_start(counts: DataFrame, store: Stage) -> DataFrame:
    """Adds the number of rows of the same key before each container, and the key's total.

    Counts are added up over 4,096 siblings at a time until a key has no more than that many; running sums then go down the
    same steps, each within siblings.
    """
    steps = [counts.select("key", "high", "n")]
    while (steps[-1].groupBy("key").count().agg(F.max("count").alias("n")).first()["n"] or 0) > 1 << STEP_BITS:
        steps.append(store.write(f"steps-{len(steps)}", steps[-1].groupBy("key", F.shiftright("high", STEP_BITS).alias("high")).agg(F.sum("n").alias("n"))))
    before = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("high").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    started = steps.pop().withColumns({"start": before("key"), "total": F.sum("n").over(W.partitionBy("key"))})
    while steps:
        above = started.select("key", F.col("high").alias("parent"), F.col("start").alias("offset"), "total")
        level = steps.pop().withColumn("parent", F.shiftright("high", STEP_BITS))
        level = level.withColumn("within", before("key", "parent")).join(above, ["key", "parent"])
        started = level.select("key", "high", "n", (F.col("offset") + F.col("within")).alias("start"), "total")
    return counts.join(started.select("key", "high", "start", "total"), ["key", "high"])


def bits_below(low: Column) -> Column:
    """Bits of the container's words below the place ``low``."""
    at, mask = F.shiftright(low, 6), F.expr("~shiftleft(-1L, low & 63)")
    counted = [F.bit_count(F.when(at > k, word(k)).when(at == k, word(k).bitwiseAND(mask)).otherwise(F.lit(0).cast("long"))) for k in range(WORDS)]
    return sum(counted[1:], counted[0]).cast("long")


def coordinates(rows: DataFrame, store: Stage) -> DataFrame:
    """Adds pos, the row's place in its key from 0, and total, the key's rows. rows: key, high, low, leaf and others."""
    directory = store.write("directory", with_start(store.write("containers", containers(rows)), store))
    ranked = rows.join(directory, ["key", "high"])
    columns = [*rows.columns, "total"]
    place = F.col("start") + bits_below(F.col("low"))
    if directory.filter("n > ids").isEmpty():
        return ranked.withColumn("pos", place).select(*columns, "pos")
    single = ranked.filter("n = ids").withColumn("pos", place).select(*columns, "pos")
    # containers with ties: rows of smaller ids count as often as they are found, rows of one id are ordered by their leaves
    tied = store.write("tied", ranked.filter("n > ids").withColumn("below", place).select(*columns, "below").groupBy(*columns, "below").agg(F.count(F.lit(1)).alias("copies")))
    more = tied.groupBy("key", "high", "low").agg((F.sum("copies") - 1).alias("extra")).filter("extra > 0")
    extras = more.groupBy("key", "high").agg(F.collect_list(F.struct("low", "extra")).alias("extras"))  # at most 512
    unfolded = tied.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    ordered = with_rank(unfolded.withColumn("place_of", F.struct("key", "high", "low", "leaf", "copy")), "place_of", stage(rows.sparkSession))
    ordered = store.write("ordered-ties", ordered)
    first = ordered.groupBy("key", "high", "low").agg(F.min("rank").alias("first"))
    smaller = F.aggregate(F.filter("extras", lambda x: x["low"] < F.col("low")), F.lit(0).cast("long"), lambda n, x: n + x["extra"])
    placed = ordered.join(first, ["key", "high", "low"]).join(extras, ["key", "high"]).withColumn("pos", F.col("below") + smaller + F.col("rank") - F.col("first"))
    return single.unionByName(placed.select(*columns, "pos"))


def joined_runs(nodes: Column) -> Column:
    """The next level: each run of FAN nodes as one digest."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, FAN), ""), 256))


def blocks_of(nodes: DataFrame) -> DataFrame:
    """key, block, height (levels above the block's nodes), slots, and the levels and top of every block.

    nodes: key, pos, total, node (the digest) and others, which go into the slots.
    """
    carried = [c for c in nodes.columns if c not in ("key", "total")]
    height = sum((F.when(F.col("total") > FAN**k, 1).otherwise(0) for k in range(1, 21)), F.when(F.col("total") > 1, 1).otherwise(0))
    grouped = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("pos", *(c for c in carried if c != "pos")))).alias("slots"))
    found = grouped.withColumn("height", height).withColumn("level0", F.transform("slots", lambda x: x["node"]))
    for k in range(1, LEVELS + 1):
        found = found.withColumn(f"level{k}", F.when(F.col("height") >= k, joined_runs(F.col(f"level{k - 1}"))))
    top = F.coalesce(*(F.col(f"level{k}") for k in range(LEVELS, -1, -1)))[0]
    return found.withColumn("top", top).drop(f"level{LEVELS}")


def reduced(nodes: DataFrame, store: Stage, name: str) -> list[DataFrame]:
    """Tables of blocks, from the nodes up to one block a key."""
    tables = []
    while True:
        tables.append(store.write(f"{name}-{len(tables)}", blocks_of(nodes)))
        if not tables[-1].agg(F.max("block").alias("n")).first()["n"]:
            return tables
        nodes = tables[-1].filter(F.col("height") > LEVELS).select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("node"))


def tops(tables: list[DataFrame]) -> DataFrame:
    """key and top of every tree."""
    ended = [t.filter(F.col("height") <= LEVELS).select("key", "top") for t in tables]
    out = ended[0]
    for other in ended[1:]:
        out = out.unionByName(other)
    return out


def own_path(at: Column) -> Column:
    """What stands left and right of the block's node ``at`` in its run, for each of the block's levels."""
    levels = []
    for k in range(LEVELS):
        nodes, place = F.col(f"level{k}"), F.floor(at / FAN**k).cast("int")
        run = F.floor(place / FAN).cast("int") * FAN
        levels.append(F.struct(F.array_join(F.slice(nodes, run + 1, place - run), "").alias("left"), F.array_join(F.slice(nodes, place + 2, run + FAN - 1 - place), "").alias("right")))
    return F.slice(F.array(*levels), 1, F.least(F.col("height"), F.lit(LEVELS)))


def with_paths(tables: list[DataFrame], above: DataFrame, store: Stage, name: str) -> DataFrame:
    """The lowest blocks with ``path``, which is above their tops. above: key and the path above its tree's top."""
    path = None
    for k in range(len(tables) - 1, -1, -1):
        ended = tables[k].filter(F.col("height") <= LEVELS).select("key", "block").join(above, "key")
        path = ended if path is None else path.unionByName(ended)
        located = tables[k].join(path, ["key", "block"])
        if k:
            below = located.select("key", F.explode(F.transform("slots", lambda x, i: F.struct(x["pos"].alias("block"), F.concat(own_path(i), F.col("path")).alias("path")))).alias("x"))
            path = store.write(f"{name}-paths-{k}", below.select("key", "x.block", "x.path"))
    return located


def merkle_manifest(frame: DataFrame, columns: Sequence[str], id_column: str = "doc_id", group_column: str = "lang", claimed: Column | None = None) -> DataFrame:
    """id, group, pos, leaf, claimed, subroot, root and path of every row.

    The leaf is the digest of ``columns``; ``claimed`` is any string carried along, such as the leaf of a copy to be
    checked. ``path`` holds, from the leaf up to the root, the joined digests left and right of the row's node in its run.
    """
    store = stage(frame.sparkSession)
    group, number = F.col(f"`{group_column}`").cast("string"), F.col(f"`{id_column}`").cast("long")
    key = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    high, low = F.coalesce(F.shiftright(number, ID_BITS), F.lit(NULL_ID)), F.coalesce(number.bitwiseAND((1 << ID_BITS) - 1), F.lit(0)).cast("int")
    leaf = digest([F.col(f"`{c}`") for c in columns])
    rows = store.write("digests", frame.select(key.alias("key"), high.alias("high"), low.alias("low"), leaf.alias("leaf"), (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed")))
    nodes = coordinates(rows, store).withColumnRenamed("leaf", "node")
    trees = reduced(nodes, store, "trees")
    subroots = store.write("subroots", with_rank(tops(trees), "key", store))
    listed = subroots.select(F.lit("").alias("key"), F.col("rank").alias("pos"), F.lit(subroots.count()).cast("long").alias("total"), F.col("top").alias("node"), F.col("key").alias("of"))
    crown = reduced(listed, store, "crown")
    root = tops(crown).first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    lowest = with_paths(crown, tops(crown).select("key", nothing.alias("path")), store, "crown")
    above = lowest.select(F.explode(F.transform("slots", lambda x, i: F.struct(x["of"].alias("key"), F.concat(own_path(i), F.col("path")).alias("path")))).alias("x")).select("x.*")
    located = with_paths(trees, store.write("above", above), store, "trees").join(subroots.select("key", F.col("top").alias("subroot")), "key")
    found = located.select(
        "key", "subroot", F.explode(F.transform("slots", lambda x, i: F.struct(x["pos"].alias("pos"), x["high"].alias("high"), x["low"].alias("low"), x["node"].alias("leaf"), x["claimed"].alias("claimed"), F.concat(own_path(i), F.col("path")).alias("path")))).alias("x")
    ).select("key", "subroot", "x.*")
    return found.select(
        F.when(F.col("high") != NULL_ID, F.shiftleft("high", ID_BITS) + F.col("low")).alias(id_column),
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias(group_column),
        "pos", "leaf", "claimed", "subroot", F.lit(root["top"] if root else None).alias("root"), "path",
    )


def proof_text(path: Column) -> Column:
    """The digests beside the row's nodes, level by level, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = digest([F.translate(F.col(c), UPPER, LOWER) if c == "text" else F.col(c) for c in columns])
    found = merkle_manifest(docs, columns, claimed=F.when(changed, tampered))
    folded_root = folded(F.coalesce("claimed", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), folded_root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest_sql() -> str:
    """DuckDB SQL for the query's rows; ids must be unique and not null."""
    piece = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(piece(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    turns = "c"
    for _ in range(8):
        turns = f"list_transform({turns}, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)"
    crc = "xor(list_reduce(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    siblings = "coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < w.pos), '')", "coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > w.pos), '')"
    return f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {turns} AS t FROM (SELECT list_transform(range(256), lambda x: x::BIGINT) AS c)),
d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS key, {leaf('text')} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf('text')} END AS claimed FROM documents, crc_table),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS pos FROM d),
up AS (
  SELECT key, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY key) AS n FROM p
  UNION ALL
  SELECT key, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY key, lvl, pos // 8),
tree AS MATERIALIZED (SELECT * FROM up),
sub AS MATERIALIZED (SELECT key, h AS subroot, lvl AS height, row_number() OVER (ORDER BY key) - 1 AS pos FROM tree WHERE n = 1),
over_up AS (
  SELECT 0 AS lvl, pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM over_up WHERE n > 1 GROUP BY lvl, pos // 8),
crown AS MATERIALIZED (SELECT * FROM over_up),
-- all nodes as one tree a document walks up: first its language's, then the languages'
nodes AS MATERIALIZED (
  SELECT key, lvl, pos, h, n FROM tree WHERE n > 1
  UNION ALL
  SELECT s.key, s.height + c.lvl, c.pos, c.h, c.n FROM sub s, crown c WHERE c.n > 1),
walk AS (
  SELECT doc_id, key, 0 AS lvl, pos, claimed AS node, '' AS proof, FALSE AS ended FROM p
  UNION ALL
  SELECT doc_id, key, lvl + 1, here // 8, sha256(l || node || r), proof || l || r, FALSE FROM (
    SELECT w.doc_id, w.key, w.lvl, w.here, any_value(w.node) AS node, any_value(w.proof) AS proof, {siblings[0].replace('w.pos', 'w.here')} AS l, {siblings[1].replace('w.pos', 'w.here')} AS r
    FROM (SELECT walk.*, CASE WHEN walk.lvl = sub.height THEN sub.pos ELSE walk.pos END AS here FROM walk JOIN sub USING (key)) w
    JOIN nodes s ON s.key = w.key AND s.lvl = w.lvl AND s.pos // 8 = w.here // 8 GROUP BY w.doc_id, w.key, w.lvl, w.here)),
last AS (SELECT doc_id, arg_max(node, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM walk GROUP BY doc_id),
top AS (SELECT h AS root FROM crown WHERE n = 1)
SELECT p.doc_id, p.leaf, sub.subroot, top.root, sha256(last.proof) AS proof_sha256, last.folded_root, last.folded_root = top.root AS verified
FROM p JOIN sub USING (key) JOIN last USING (doc_id), top
"""
