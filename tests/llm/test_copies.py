"""Operators that compare texts: near duplicates, decontamination, repeated passages."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from placebeat.llm import decontamination, kernel, near_duplicates, repeated_passages
from placebeat.llm.components import components
from placebeat.llm.support import stage
from tests.comparing import oracle
from tests.llm import brute


def sentence(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def check_near(found, rows):
    wanted = brute.near_components(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_shingles"], r["component_id"]) == wanted[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_the_table(spark, small):
    rows = oracle(small).execute("SELECT doc_id, text FROM documents").fetchall()
    check_near(near_duplicates.op3_near_duplicates(spark, small).collect(), rows)


def test_near_duplicates_around_the_threshold(spark):
    """Groups of copies with so many edits that some pairs are above and some below the threshold, chains included."""
    rng, rows = random.Random(3), []
    for _ in range(25):
        base = sentence(rng, rng.choice((6, 30, 80, 200)))
        for _ in range(rng.randint(2, 12)):
            rows.append((len(rows), " ".join(edited(rng, base, rng.randint(0, max(1, len(base) // 25))))))
        chain = base
        for _ in range(6):
            chain = edited(rng, chain, max(1, len(chain) // 60))
            rows.append((len(rows), " ".join(chain).upper()))
    passage = sentence(rng, 60)  # shared by many otherwise different texts
    rows += [(len(rows) + k, " ".join(sentence(rng, 30) + passage + sentence(rng, 30))) for k in range(60)]
    rows += [(5000 + k, t) for k, t in enumerate([None, "", "one", "one", "One two", "a b c d e", "A B C D E"])]
    rng.shuffle(rows)
    check_near(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = sentence(rng, 120)
    rows = [(k, " ".join(edited(rng, base, 1))) for k in range(400)]
    counts, real = [], near_duplicates.verified
    monkeypatch.setattr(near_duplicates, "verified", lambda pairs, *a: counts.append(pairs.count()) or real(pairs, *a))
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert sum(counts) < 12 * len(rows)  # all pairs would be 79,800


def test_sketch_coordinates_agree_like_the_sets():
    rng, bins = np.random.default_rng(1), 240
    for size, shared in ((3, 2), (50, 40), (2000, 1500)):
        agree = []
        for _ in range(30):
            both = rng.integers(0, 1 << 62, shared).astype(np.uint64)
            a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 62, size - shared).astype(np.uint64)))) for _ in range(2))
            s = near_duplicates.sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), 2, bins)
            assert (s < np.iinfo(np.uint64).max).all()
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - shared / (2 * size - shared)) < 0.04


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7), (9, 8), (8, 9), (9, 8), (700, 701), (702, 703), (703, 700)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), stage(spark), "t").collect()}
    assert all(found[k] == 100 for k in range(100, 161)) and all(found[k] == 500 for k in range(500, 540))
    assert found[9] == found[8] == 8 and {found[k] for k in range(700, 704)} == {700}
    assert components(spark.createDataFrame([], "a long, b long"), stage(spark), "e").count() == 0


def test_every_leak_of_the_table_and_no_other(spark, small):
    database = oracle(small)
    docs = database.execute("SELECT doc_id, text FROM documents").fetchall()
    items = database.execute("SELECT item_id, text FROM benchmark").fetchall()
    words = lambda t: " ".join(kernel_words(t))
    plain = {d: words(t) for d, t in docs}
    wanted = {(d, i) for i, t in items for own in [words(t)] for d, text in plain.items() if own in text}
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.op9_decontamination(spark, small).collect()}
    assert found >= wanted and len(found - wanted) <= 0.02 * len(wanted) + 1


def kernel_words(text):
    for _, _, data, offsets in kernel.chunks(pa.array([text])):
        words = kernel.Words(data, offsets, kernel.MARKS)
        return [brute.fold(data[a:b].tobytes().decode()) for a, b in zip(words.start, words.end, strict=True)]


def test_paraphrases_are_found_and_answers_count(spark):
    rng = random.Random(12)
    common = [f"c{k}" for k in range(40)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(4000)}" for _ in range(n)]
    questions = [[*prose(20), "x."] for _ in range(30)]
    items = [(k, " ".join(q + [f"answer{k}", f"is{k}", f"value{k}."])) for k, q in enumerate(questions)]
    docs = []
    for k in range(300):
        text = prose(rng.randint(20, 300))
        if k < 30:  # a word in five replaced, the answer kept
            own = [w if rng.random() > 0.2 else f"p{rng.randrange(10**5)}" for w in items[k][1].split()[:-3]] + items[k][1].split()[-3:]
            text[10:10] = own
        elif k < 60:  # two of five replaced, and another answer
            own = [w if j % 5 > 1 else f"p{rng.randrange(10**5)}" for j, w in enumerate(questions[k - 30])] + ["no", "such", "thing."]
            text[10:10] = own
        docs.append((k, " ".join(text)))
    schema = "{} long, text string"
    found = decontamination.decontamination(spark.createDataFrame(docs, schema.format("doc_id")), spark.createDataFrame(items, schema.format("item_id"))).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(pairs & {(k, k) for k in range(30)}) >= 27 and len(pairs - {(k, k) for k in range(30)}) <= 1


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    rng = random.Random(1)
    items = [(k, " ".join(sentence(rng, 25)) + ".") for k in range(20)]
    docs = [(k, " ".join(sentence(rng, 50)) + " " + (items[k][1] if k < 20 else "") + " " + " ".join(sentence(rng, 50))) for k in range(60)]
    docs.append((99, " ".join(t for _, t in items)))
    schema = "{} long, text string"
    frames = spark.createDataFrame(docs, schema.format("doc_id")), spark.createDataFrame(items, schema.format("item_id"))
    one = {(r["doc_id"], r["item_id"]) for r in decontamination.decontamination(*frames).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1000)
    many = {(r["doc_id"], r["item_id"]) for r in decontamination.decontamination(*frames).collect()}
    assert one == many == {(k, k) for k in range(20)} | {(99, k) for k in range(20)}


def test_projection_is_the_leading_space(spark):
    """Against a dense decomposition of the same rows."""
    rng = random.Random(5)
    items = [(k, " ".join(f"t{rng.randrange(60)}" for _ in range(16))) for k in range(12)]
    docs = [(k, " ".join(f"t{min(59, int(rng.expovariate(0.15)))}" for _ in range(32))) for k in range(200)]
    pieces = decontamination.cut(items)
    weight = np.ones(len(pieces.terms))
    space = decontamination.projection(spark.createDataFrame(docs, "id long, text string"), pieces, weight, 40, 1)
    rows = []
    for text in [t for _, t in docs]:
        _, hashes = decontamination.folded([text])
        at = decontamination.positions(hashes, pieces.terms)
        row = np.bincount(at[at >= 0], minlength=len(pieces.terms)).astype(float)
        rows.append(row / max(np.linalg.norm(row), 1e-12))
    piece, term, value = decontamination.piece_rows(pieces, weight)
    own = np.zeros((len(pieces.words), len(pieces.terms)))
    own[piece, term] = value
    whole = np.vstack([*rows, own])
    _, _, right = np.linalg.svd(whole, full_matrices=False)
    assert np.linalg.norm(space.T @ space - np.eye(space.shape[1])) < 1e-3
    kept = np.linalg.norm(whole @ space) ** 2 / np.linalg.norm(whole) ** 2
    best = np.linalg.norm(whole @ right[: space.shape[1]].T) ** 2 / np.linalg.norm(whole) ** 2
    assert kept > 0.95 * best


def test_common_subsequence():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert decontamination.common_subsequence(masks, len(a), b) == table[-1][-1]


def check_repeats(found, rows):
    wanted = brute.repeated(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_words"], r["n_repeated_words"], r["n_later_words"], r["spans"], r["later_spans"]) == wanted[r["doc_id"]], r["doc_id"]


def test_repeated_passages_of_the_table(spark, small):
    rows = oracle(small).execute("SELECT doc_id, text FROM documents").fetchall()
    check_repeats(repeated_passages.op10_repeated_passages(spark, small).collect(), rows)


def test_repeated_passages_at_the_limit(spark):
    rng, rows = random.Random(11), []
    passages = [sentence(rng, n) for n in (48, 49, 50, 51, 60, 90, 200)] + [["|"] * 60, ["a", "b"] * 40]
    for k in range(120):
        words = sentence(rng, rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            own = rng.choice(passages)
            a = rng.randint(0, max(0, len(own) - 45))
            words += own[a : a + rng.randint(45, 120)] + sentence(rng, rng.randint(0, 5))
        rows.append((k, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " ".join(passages[6])), (1003, " ".join(passages[6] * 2))]
    rng.shuffle(rows)
    check_repeats(repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_retained_suffixes_depend_on_the_passage_alone():
    rng = random.Random(13)
    passage = sentence(rng, 50)
    kept = []
    for before in (0, 7, 33):
        text = " ".join(sentence(rng, before) + passage + sentence(rng, before))
        for _, _, data, offsets in kernel.chunks(pa.array([text])):
            words = kernel.Words(data, offsets)
            at, _ = repeated_passages.minimisers(words, kernel.Prefix(words.hashes()), 50, 32)
            kept.append({int(x) - before for x in at if before <= x <= before + 18})
    common = set.intersection(*kept)
    assert common


def test_rows_of_pieces_are_sparse():
    """The same products as a dense matrix; a block of very short items stays small on the driver."""
    rng = random.Random(17)
    pieces = decontamination.cut([(k, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 40)))) for k in range(80)])
    gen = np.random.default_rng(1)
    weight = gen.random(len(pieces.terms)) * (gen.random(len(pieces.terms)) > 0.3)
    piece, term, value = decontamination.piece_rows(pieces, weight)
    dense = np.zeros((len(pieces.words), len(pieces.terms)))
    for k, words in enumerate(pieces.words):
        for x in words:
            dense[k, np.searchsorted(pieces.terms, x)] += 1
    dense *= weight
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    sparse = np.zeros_like(dense)
    sparse[piece, term] = value
    assert np.allclose(sparse, dense) and (value != 0).all()
    matrix = gen.random((len(pieces.terms), 7))
    assert np.allclose(decontamination.added_up(np.zeros((len(pieces.words), 7)), piece, matrix, term, value), dense @ matrix)
    short = decontamination.cut([(k, " ".join(f"x{rng.randrange(40_000)}" for _ in range(3))) for k in range(20_000)])
    tracemalloc.start()
    piece, term, value = decontamination.piece_rows(short, np.ones(len(short.terms)))
    decontamination.added_up(np.zeros((len(short.words), 128)), piece, np.ones((len(short.terms), 128)), term, value)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(short.words) >= 20_000
