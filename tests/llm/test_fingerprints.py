"""Document fingerprints against plain Python that shares only Spark's hash of a word pair and of a stretch."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from placebeat.llm import document_fingerprints as dp
from tests.llm.brute import WORD

K, S = dp.K, dp.S


@pytest.fixture(scope="module")
def hashes(spark):
    """A function that hashes lists of tuples with Spark."""

    def of(tuples, kind):
        if not tuples:
            return {}
        fields = ", ".join(f"c{k} {kind}" for k in range(len(tuples[0])))
        frame = spark.createDataFrame(tuples, fields)
        return {tuple(r)[:-1]: r[-1] for r in frame.select("*", F.xxhash64(*frame.columns)).collect()}

    return of


def anchors(words, pair_hash, stretch_hash):
    """(place, hash) of the closed syncmers of a text."""
    pairs = [pair_hash[a, b] for a, b in zip(words, words[1:])]
    out = []
    for i in range(len(words) - K + 1):
        inner = pairs[i : i + K - S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, stretch_hash[tuple(pairs[i : i + K - S + 1 : S])] & 0xFFFFFFFF))
    return out


def brute_prints(texts, hashes):
    split = [WORD.findall(t or "") for t in texts]
    pair_hash = hashes(sorted({(a, b) for w in split for a, b in zip(w, w[1:])}), "string")
    pairs = [[pair_hash[a, b] for a, b in zip(w, w[1:])] for w in split]
    stretch_hash = hashes(sorted({tuple(p[i : i + K - S + 1 : S]) for p in pairs for i in range(len(p) - K + S)}), "long")
    short = hashes(sorted({(" ".join(w),) for w in split if 0 < len(w) < 2 * K}), "string")
    out = []
    for w in split:
        if not w:
            out.append("")
            continue
        found = anchors(w, pair_hash, stretch_hash) or [(0, short[(" ".join(w),)] & 0xFFFFFFFF)]
        before, mark = 0, ""
        for place, value in found:
            mark += f"{place - before:x}{value:08x}"
            before = place
        out.append(mark + f"{len(w) - before:x}")
    return out


def brute_likeness(a, b):
    def links(mark):
        if not mark:
            return set()
        records = [mark[k : k + 9] for k in range(0, len(mark) - 1, 9)]
        ends = {("first", records[0]), ("last", records[-1][1:] + mark[-1])}
        return ends | {(x[1:], y) for x, y in zip(records, records[1:])}

    x, y = links(a), links(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def halves(rows):
    """id -> next text for unique ids."""
    ordered = sorted(rows, key=lambda r: -r[0])
    return {r[0]: ordered[(k + 1) % len(ordered)][1] or "" for k, r in enumerate(ordered)}


def edited(text, following):
    text = text or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def rows_of(rng, n):
    words = lambda k: " ".join(rng.choice(("a", "b", f"w{rng.randrange(400)}", "é🙂")) for _ in range(k))
    texts = [None, "", " \n\t", "one", "one two three four five six seven", "a b c d e f g h", *(words(n) for n in range(8, 16)), "word\x0bother\x1fjoined  " * 12]
    texts += [words(rng.choice((3, 8, 12, 40, 300))) for _ in range(n)]
    texts += [texts[-1], texts[-1] + " more", words(4000)]
    ids = rng.sample(range(-1000, 1000), len(texts))
    return list(zip(ids, texts))


def test_against_brute_force(spark, hashes):
    rows = rows_of(random.Random(12), 60)
    found = {r["doc_id"]: r for r in dp.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    following = halves(rows)
    wanted = [edited(t, following[i]) for i, t in rows]
    marks = brute_prints([t for _, t in rows] + wanted, hashes)
    mark_of = dict(zip([i for i, _ in rows], marks))
    next_of = dict(zip(sorted(mark_of, reverse=True), [*sorted(mark_of, reverse=True)[1:], max(mark_of)]))
    assert len(found) == len(rows)
    for (i, text), want, mark, other in zip(rows, wanted, marks, marks[len(rows) :]):
        r = found[i]
        assert (r["n_chars"], r["edited"], r["fingerprint"], r["edited_fingerprint"]) == (len(text or ""), want, mark, other)
        assert r["near_edited"] == pytest.approx(brute_likeness(mark, other)) and r["near_next"] == pytest.approx(brute_likeness(mark, mark_of[next_of[i]]))


def test_the_table(spark, small, hashes):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    following = halves(rows)
    found = {r["doc_id"]: r for r in dp.op12_document_fingerprints(spark, small).collect()}
    marks = brute_prints([t for _, t in rows], hashes)
    assert len(found) == len(rows)
    for (i, text), mark in zip(rows, marks):
        want = edited(text, following[i])
        assert (found[i]["n_chars"], found[i]["edited_sha256"], found[i]["fingerprint"]) == (len(text), hashlib.sha256(want.encode()).hexdigest(), mark)
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
    assert sum(r["near_edited"] for r in found.values()) / len(found) > 0.25  # half of the text is still there


def test_anchors_are_context_free(spark):
    """A passage has the same anchors wherever it stands; no K - S words are without one."""
    rng = random.Random(5)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(200))
    texts = [passage, "some words before it " * 7 + passage, passage + " and after" * 30]
    found = [r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dp.fingerprint(F.col("t")).alias("m")).collect()]
    records = [set(re.findall(".{9}", m)[1:]) for m in found]
    assert len(records[0] & records[1]) >= len(records[0]) - 2 and len(records[0] & records[2]) == len(records[0])
    assert all(1 <= int(x[0], 16) <= K - S for x in records[0])


def test_likeness_grows_with_what_is_common(spark):
    rng = random.Random(6)
    base = [f"q{rng.randrange(10**6)}" for _ in range(600)]
    texts = [" ".join(base), *(" ".join(base[:n] + [f"r{rng.randrange(10**6)}" for _ in range(600 - n)]) for n in (540, 300, 60)), " ".join(["inserted"] * 3 + base)]
    frame = spark.createDataFrame([(texts[0], t) for t in texts], "a string, b string")
    near = [r[0] for r in frame.select(dp.likeness(dp.links(dp.fingerprint(F.col("a"))), dp.links(dp.fingerprint(F.col("b"))))).collect()]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] and 0.7 < near[1] < 0.95 and near[2] == pytest.approx(1 / 3, abs=0.06) and near[4] > 0.95


def test_ties_nulls_and_hot_ids(spark):
    """Rows of one id share the next document; rows without an id have none."""
    rows = [(9, "the quick brown fox"), (9, "the quick brown fox"), (9, "quite another text here"), (None, "no id at all"), (None, None), (3, "a lazy dog sleeps"), *[(5, f"text number {k}") for k in range(200)]]
    found = dp.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[9]) == 3 and len({r["next_fingerprint"] for r in by[9]}) == 1 and len({r["next_fingerprint"] for r in by[5]}) == 1
    assert by[5][0]["next_fingerprint"] == by[3][0]["fingerprint"] and by[3][0]["next_fingerprint"] in {r["fingerprint"] for r in by[9]}
    assert {r["edited"] for r in by[None]} == {"", "no id "} and {r["near_next"] for r in by[None]} == {0.0, 1.0}
    alone = dp.document_fingerprints(spark.createDataFrame([(1, "only one")], "doc_id long, text string")).first()
    assert (alone["edited"], alone["near_next"]) == ("onlyonly", 1.0)


def test_no_python(spark, small):
    plan = dp.op12_document_fingerprints(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
