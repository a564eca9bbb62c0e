"""Merkle manifest against plain Python and SQL: ties, null ids and groups, widely spread ids, tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from placebeat.llm import merkle_manifest as mm
from tests.comparing import difference, oracle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Root and, for each node, its (left, right) pairs from the bottom up."""
    paths, where, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, at in enumerate(where):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            paths[k].append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
            where[k] = at // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[g] = tree([leaf_of(r, r[1]) for r in groups[g]])
    root, crown = tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, crown, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            path = path + above
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for left, right in path:
                node = sha(left + node + right)
            out.append((r[0], leaf_of(r, r[1]), trees[g][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def query(frame):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = mm.digest([F.translate(F.col(c), mm.UPPER, mm.LOWER) if c == "text" else F.col(c) for c in COLUMNS])
    found = mm.merkle_manifest(frame, COLUMNS, claimed=F.when(changed, tampered))
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(mm.proof_text(F.col("path")), 256), mm.folded(F.coalesce("claimed", "leaf"), F.col("path")), (mm.folded(F.coalesce("claimed", "leaf"), F.col("path")) == F.col("root")))
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def document(rng, i, lang):
    return (i, rng.choice([None, "", f"Text {i} Ünï", "lower only", "X" * rng.randrange(40)]), lang, rng.choice([None, "a", "b"]), rng.choice([None, 3]))


CASES = {
    "one row": [(5, "Only", "en", "s", 4)],
    "one null row": [(None, None, None, None, None)],
    "eight and nine": [(k, f"T{k}", "en" if k < 8 else "fr", "s", 1) for k in range(17)],
    "a lang over a block and one of a leaf": [(k, f"T{k}", "en", "s", 1) for k in range(1030)] + [(9, "b", "de", None, 1)],
    "many langs": [(k, f"T{k}", f"l{k % 70}", "s", 1) for k in range(200)],
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, name):
    assert query(spark.createDataFrame(CASES[name], SCHEMA)) == brute(CASES[name])


def test_spread_ids_and_ties(spark):
    rng = random.Random(11)
    langs = ["en", "de", None, "", "é", "z"]
    rows = [document(rng, rng.choice([rng.randrange(-60, 60), rng.randrange(-(2**63), 2**63), rng.randrange(5000)]), rng.choice(langs)) for _ in range(700)]
    rows += [document(rng, rng.choice([None, 7, -(2**63), 2**63 - 1]), rng.choice(langs)) for _ in range(300)]  # hot ids
    rows += [(7, "Copy", "en", "a", 1)] * 400
    assert query(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_directory_in_steps(spark, monkeypatch):
    """Several steps of counts, as in tables with many containers."""
    monkeypatch.setattr(mm, "STEP_BITS", 2)
    rng = random.Random(4)
    rows = [(rng.randrange(-(2**40), 2**40), f"T{k}", rng.choice(["en", "de"]), "s", k) for k in range(300)]
    assert query(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty(spark):
    assert query(spark.createDataFrame([], SCHEMA)) == []


def test_proofs_verify_and_tampering_shows(spark, small):
    rows = mm.op11_merkle_manifest(spark, small).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(docs) and len({r["root"] for r in rows}) == 1
    for r in rows:
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in docs[r["doc_id"]])
        assert r["verified"] == (not touched)


def test_equals_sql(spark, small):
    assert difference(mm.op11_merkle_manifest(spark, small), mm.manifest_sql(), oracle(small)) is None


def test_no_python_and_no_single_task(spark, small):
    found = mm.op11_merkle_manifest(spark, small)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "SinglePartition" not in plan
