"""The pipeline, stage by stage, against brute force on each stage's own input."""

from pathlib import Path

import pytest

import corpus_pipeline
from placebeat.llm import decontamination, quality_rules
from placebeat.llm.support import stage
from placebeat.plans.stage import shared_folder
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, small):
    """Input and output of every stage, as rows by id."""
    store, docs = stage(spark), spark.read.parquet(f"{small}/documents.parquet")
    tables = [docs]
    for k, (_, function) in enumerate(corpus_pipeline.STAGES):
        tables.append(store.write(f"s{k}", function(spark, tables[-1], small)))
    return [{r["doc_id"]: r for r in t.collect()} for t in tables]


def test_quality(spark, small, stages):
    kept = {r["doc_id"] for r in quality_rules.op2_quality_rules(spark, small).collect() if r["kept"]}
    assert set(stages[1]) == kept and all(stages[1][k] == stages[0][k] for k in kept)
    assert not any(brute.base_rules(r["text"])[-1] for r in stages[1].values())


def test_near_duplicates(stages):
    groups = brute.near_components([(k, r["text"]) for k, r in stages[1].items()])
    assert set(stages[2]) == {low for _, low in groups.values()}


def test_decontamination(spark, small, stages):
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    dirty = {k for k, r in stages[2].items() if any(x in r["text"] for x in items)}
    gone = set(stages[2]) - set(stages[3])
    assert dirty <= gone and len(gone - dirty) <= 2


def test_secrets(stages):
    assert set(stages[4]) == set(stages[3])
    for k, r in stages[4].items():
        before = brute.base_secrets(stages[3][k]["text"])
        assert ("[SECRET]" in r["text"]) == bool(before) and not brute.base_secrets(r["text"]) and r["n_chars"] == len(r["text"])


def test_mix(spark, small, stages):
    sizes = {k: len(brute.WORD.findall(r["text"])) for k, r in stages[4].items()}
    assert {k: r["size"] for k, r in stages[5].items()} == sizes
    assert abs(sum(r["taken"] for r in stages[5].values()) - 1.5 * sum(sizes.values())) < 50


def test_run_is_the_stages(spark, small, stages):
    assert {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()} == stages[5]


def test_leaks_of_a_stage_are_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = decontamination.decontamination(docs, spark.read.parquet(f"{small}/benchmark.parquet"))
    assert found.columns == ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"]


def test_rows_that_share_an_id_or_have_none_are_judged_by_their_texts(spark, small):
    """Clean texts stay whatever their ids; copies and leaks go whatever theirs."""
    plain = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    item = max((r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()), key=len)
    rows = [
        (1, plain(1)), (1, plain(2)), (1, plain(1)), (None, plain(3)), (None, plain(3) + " more"), (None, plain(4)), (2, plain(1) + " end"), (3, plain(5)), (3, f"{plain(6)} {item} {plain(7)}"),
        (None, f"{plain(8)} {item} {plain(9)}"), (4, None), (5, ""), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    once = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicate(spark, docs, small).collect()), key=repr)
    ones = [r for r in once if r[1] in (plain(3), plain(3) + " more")]
    assert len(ones) == 1
    rest = [(1, plain(1)), (1, plain(2)), (None, plain(4)), *rows[7:]]
    assert sorted((r for r in once if r not in ones), key=repr) == sorted(rest, key=repr)
    clean = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, docs, small).collect()), key=repr)
    assert clean == sorted((r for r in rows if item not in (r[1] or "")), key=repr)


def test_stages_leave_no_tables_of_their_operators(spark, small):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.glob("stage-*/*"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k in (1, 2):
        corpus_pipeline.STAGES[k][1](spark, docs, small)
    assert {x.name for x in set(folder.glob("stage-*/*")) - before} == {"kept", "leaks"}
