"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest

import corpus_pipeline
from placebeat.llm import decontamination, document_fingerprints, html_extraction, license_scans, merkle_manifest, mixing, near_duplicates, quality_rules, repeated_passages, secret_scans, token_counts, url_filters

CLASHING = ("id", "row", "size", "target", "class", "key", "seed", "node", "root", "measures", "host", "kind", "bucket", "row_number_", "of", "part", "spans", "plain")
LONG = " ".join(f"word{k % 977} token=abcdef{k:08d}" for k in range(40_000))
DOCUMENTS = [
    (1, "a plain text " * 20, "en", "s1", 1), (1, "a plain text " * 20, "en", "s1", 1), (2, None, None, None, None), (3, "", "", "", 0), (None, "no id", "xx", "s2", 5),
    (4, LONG, "en", "s1", len(LONG)), (5, " \n\t\x0b", "de", "s2", 4), (6, "é🙂 ﷺ \x00 end", None, "s1", 9), (7, LONG, "en", None, len(LONG)),
]
PAGES = [(1, "http://a.org/x", "<p>x"), (1, "http://a.org/x", "<p>x"), (2, None, None), (3, "", ""), (None, "http://b.com/de/", "<a href=//a.org>"), (4, "http://c.net", "<p>word " * 50_000)]


def widened(spark, rows, schema):
    extra = ", ".join(f"{x} string" for x in CLASHING)
    return spark.createDataFrame([(*r, *(["x"] * len(CLASHING))) for r in rows], f"{schema}, {extra}")


@pytest.fixture(scope="module", params=["rows", "empty"])
def documents(spark, request):
    return widened(spark, DOCUMENTS if request.param == "rows" else [], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module", params=["rows", "empty"])
def pages(spark, request):
    return widened(spark, PAGES if request.param == "rows" else [], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "word1 word2 word3 other things here"), (2, None), (None, "x y z"), (3, ""), (4, "one")], "item_id long, text string")


EACH_ROW = {
    "quality": quality_rules.quality_rules, "tokens": token_counts.token_counts, "secrets": secret_scans.secret_scans, "licenses": license_scans.license_scans, "mix": mixing.mix_sources,
    "fingerprints": document_fingerprints.document_fingerprints,
}
NAMED_ROWS = {"near": near_duplicates.near_duplicates, "repeats": repeated_passages.repeated_passages}


@pytest.mark.parametrize("name", EACH_ROW)
def test_a_row_for_each_row(documents, name):
    n = documents.count()
    rows = EACH_ROW[name](documents).collect()
    assert len(rows) == n
    if n:
        by = {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append(r)
        assert len(by[1]) == 2 and by[1][0] == by[1][1] and len(by[None]) == 1


@pytest.mark.parametrize("name", NAMED_ROWS)
def test_a_row_for_each_row_with_an_id(documents, name):
    rows = NAMED_ROWS[name](documents).collect()
    assert len(rows) == (len(DOCUMENTS) - 1 if documents.count() else 0)
    if rows and name == "near":
        groups = {r["doc_id"]: r["component_id"] for r in rows}
        assert groups == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 4}
    if rows and name == "repeats":
        assert {r["doc_id"]: r["n_later_words"] for r in rows} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 80_000}


def test_defined_results(spark):
    frame = widened(spark, DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long")
    tokens = {r["doc_id"]: r for r in token_counts.token_counts(frame).collect()}
    assert (tokens[2]["n_bytes"], tokens[2]["n_tokens"], tokens[3]["n_tokens"]) == (0, 0, 0)
    quality = {r["doc_id"]: r for r in quality_rules.quality_rules(frame).collect()}
    assert not quality[2]["kept"] and quality[2]["base_failed"] and quality[2]["token_entropy"] is None
    secrets = {r["doc_id"]: r for r in secret_scans.secret_scans(frame).collect()}
    assert secrets[2]["spans"] == "" and secrets[4]["n_assign"] == 40_000
    licenses = {r["doc_id"]: r for r in license_scans.license_scans(frame).collect()}
    assert licenses[2]["license"] is None and licenses[4]["n_licenses"] == 0


def test_manifest_of_any_rows(documents):
    """Equal rows have a coordinate each; every path leads to the root."""
    columns = ("doc_id", "source", "lang", "n_chars", "text", "size", "row_number_")
    found = merkle_manifest.merkle_manifest(documents, columns)
    rows = found.select("*", merkle_manifest.folded(found["leaf"], found["path"]).alias("to")).collect()
    assert len(rows) == documents.count() and all(r["to"] == r["root"] for r in rows)
    assert len({(r["lang"], r["pos"]) for r in rows}) == len(rows)


def test_pages(pages):
    n = pages.count()
    texts, urls = html_extraction.html_extraction(pages).collect(), url_filters.url_filters(pages).collect()
    assert len(texts) == len(urls) == n
    if n:
        assert {r["page_id"]: r["text"] for r in texts}[2] == "" and {r["page_id"]: r["verdict"] for r in urls}[2] == "allow"


def test_decontamination(spark, documents, items):
    found = decontamination.decontamination(documents, items).collect()
    assert {r["item_id"] for r in found} <= {1}
    assert decontamination.decontamination(documents, items.filter("false")).count() == 0


def test_other_names(spark):
    frame = spark.createDataFrame([(1, "some text here that is long enough for it"), (2, "some text here that is long enough for it")], "key long, body string")
    assert {r["component_id"] for r in near_duplicates.near_duplicates(frame, "key", "body").collect()} == {1}
    assert token_counts.token_counts(frame, "key", "body").columns == ["key", "n_bytes", "n_tokens"]


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, documents, small, k):
    columns = documents.columns
    out = corpus_pipeline.STAGES[k][1](spark, documents, small)
    rows = out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == columns
    if not documents.count():
        assert not rows
