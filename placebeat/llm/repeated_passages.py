"""Passages of many words that repeat across documents, by a sparse suffix array.

Suffixes begin at words. Of every ``length`` words in a row, at least one suffix is retained: the one whose first ``seed``
words have the smallest hash of all in that passage (a minimiser). What a passage retains depends on its words alone, so
two copies of it retain the same.

1. Suffixes are put in the order of their first words' hashes and equal neighbours are compared: a run of equal ones in
   two or more documents is a match of ``seed`` words. Spark does this as an aggregation by hash, map-side first.
2. A suffix also carries a hash of all words that a passage over its seed can reach, to both sides. Where a run has only
   one such surrounding, every passage in it is repeated. Else the matches are extended: for each different surrounding,
   passages that begin 0, 1, 2 ... words left of the seed and so reach less far right are compared across the run in the
   same way. Each surrounding is extended once, whatever the number of documents that share it.
3. The matched passages of a document are merged to spans of words. A span is a later copy where a document with a
   smaller id has the passage.

A passage of ``length`` words is found in all documents that have it or in none of them, so the spans are exactly the
words in passages of ``length`` or more words that another document has, too. Words are ``[^\\x20\\x09-\\x0D]+``, as they
are. Keys are hashed, so an order of them is not that of the letters; equal neighbours are the same either way.

Null, empty and shorter texts have no spans; a repeat within one document (or among rows with the same id) doesn't count;
rows with a null id can't be named and are left out; repeated rows each get their row; an empty table gives no rows;
columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebeat.llm import kernel
from placebeat.llm.support import narrow, ship, stage, table

U = np.uint64
LENGTH = 50
SEED = 32
SUFFIX = ["seed", "around", "id", "at", "left", "right"]


def sliding(values: np.ndarray, size: int, pick, forward: bool) -> np.ndarray:
    """pick over values[i : i + size] (forward) or values[i - size + 1 : i + 1], by doubling."""
    out, done = values, 1
    while done < size:
        step = min(done, size - done)
        new = out.copy()
        if step < len(out):
            if forward:
                new[:-step] = pick(out[:-step], out[step:])
            else:
                new[step:] = pick(out[step:], out[:-step])
        out, done = new, done + step
    return out


def minimisers(words: kernel.Words, prefix: kernel.Prefix, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which suffixes are retained, ascending, and the hashes of their first ``seed`` words."""
    whole = words.windows(length)
    if not len(whole):
        return whole, np.zeros(0, U)
    top = np.iinfo(U).max
    at = words.windows(seed)
    first = np.full(len(words.start), top, U)
    first[at] = prefix.spans(at, at + seed) & ~U(1)  # below top
    least = sliding(first, length - seed + 1, np.minimum, forward=True)
    of_passage = np.zeros(len(first), U)
    of_passage[whole] = least[whole]
    reached = sliding(of_passage, length - seed + 1, np.maximum, forward=False)
    kept = at[reached[at] == first[at]]
    return kept, first[kept]


def surroundings(words: kernel.Words, at: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First and behind the last word that passages over the seeds can reach."""
    row = words.row[at]
    return np.maximum(at - (length - seed), words.first[row]), np.minimum(at + length, words.first[row + 1])


def suffixes(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(seed, around, id, at, left, right) of the retained suffixes; left and right: words around in reach.

    Every row of texts has one more row without a seed, with its number of words in place of ``at``.
    """

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, offsets in kernel.chunks(batch.column(1)):
                words = kernel.Words(data, offsets)
                prefix = kernel.Prefix(words.hashes())
                at, keys = minimisers(words, prefix, length, seed)
                low, high = surroundings(words, at, length, seed)
                around = kernel.mix(prefix.spans(low, high) + (at - low).astype(U))
                row = words.row[at]
                none = pa.nulls(len(words.count), pa.int64())
                zeros = np.zeros(len(words.count), np.int32)
                counts = [none, none, batch.column(0).slice(begin, len(words.count)), pa.array(words.count.astype(np.int32)), pa.array(zeros), pa.array(zeros)]
                yield pa.RecordBatch.from_arrays(counts, SUFFIX)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64)),
                        pa.array(around.view(np.int64)),
                        batch.column(0).take(pa.array(begin + row)),
                        pa.array((at - words.first[row]).astype(np.int32)),
                        pa.array((at - low).astype(np.int32)),
                        pa.array((high - at).astype(np.int32)),
                    ],
                    SUFFIX,
                )

    return texts.mapInArrow(retain, "seed long, around long, id long, at int, left int, right int")


def extended(texts: DataFrame, length: int, seed: int) -> DataFrame:
    """(class, back, passage): the hash of each passage that begins ``back`` words left of a seed.

    texts: text and heads, an array of (class, at).
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column(1)
            counts = np.diff(np.asarray(heads.offsets))
            flat = heads.flatten()
            classes, places = flat.field(0), np.asarray(flat.field(1))
            edges = np.append(0, np.cumsum(counts))
            for begin, behind, data, offsets in kernel.chunks(batch.column(0)):
                words = kernel.Words(data, offsets)
                prefix = kernel.Prefix(words.hashes())
                of = np.arange(edges[begin], edges[behind])
                at = places[of] + np.repeat(words.first[:-1], counts[begin:behind])
                low, high = surroundings(words, at, length, seed)
                for back in range(length - seed + 1):
                    fits = (at - back >= low) & (at - back + length <= high)
                    start = at[fits] - back
                    yield pa.RecordBatch.from_arrays(
                        [classes.take(pa.array(of[fits])), pa.array(np.full(len(start), back, np.int32)), pa.array(prefix.spans(start, start + length).view(np.int64))],
                        ["class", "back", "passage"],
                    )

    return texts.mapInArrow(extend, "class long, back int, passage long")


def merged(spans: DataFrame) -> DataFrame:
    """(id, n_repeated_words, n_later_words, spans, later_spans) from an id's arrays of (start, end, later)."""

    def union(start: np.ndarray, end: np.ndarray) -> tuple[int, str]:
        if not len(start):
            return 0, ""
        order = np.argsort(start, kind="stable")
        start, reach = start[order], np.maximum.accumulate(end[order])
        new = np.append(True, start[1:] > reach[:-1])
        low, high = start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]
        return int((high - low).sum()), ",".join(f"{a}-{b}" for a, b in zip(low, high, strict=True))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            edges, flat = np.asarray(batch.column(1).offsets), batch.column(1).flatten()
            edges = edges - edges[0]
            start, end, later = (np.asarray(flat.field(k).to_numpy(zero_copy_only=False)) for k in range(3))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                copies = np.flatnonzero(later[a:b]) + a
                rows.append((*union(start[a:b], end[a:b]), *union(start[copies], end[copies])))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[3], pa.string())],
                ["id", "n_repeated_words", "n_later_words", "spans", "later_spans"],
            )

    return spans.mapInArrow(merge, "id long, n_repeated_words long, n_later_words long, spans string, later_spans string")


def repeated_passages(
    frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """id, n_words, n_repeated_words, n_later_words and both spans (of words, from 0, end exclusive) of every document."""
    ship(frame.sparkSession)
    store = stage(frame.sparkSession)
    texts = narrow(frame, id=id_column, text=text_column).filter("id is not null").select(F.col("id").cast("long").alias("id"), "text")
    whole = store.write("suffixes", suffixes(texts, length, seed))
    every = whole.filter("seed is not null")
    runs = every.groupBy("seed").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    runs = store.write("runs", runs)  # a table, so that Spark can split a hot seed in the join
    matched = store.write("matched", every.join(runs.select("seed", F.col("low").alias("run_low")), "seed"))
    surrounded = matched.groupBy("seed", "around").agg(F.min(F.struct("id", "at")).alias("head"), F.max("id").alias("high"))
    several = matched.groupBy("seed").agg(F.min("around").alias("x"), F.max("around").alias("y")).filter("x <> y").select("seed")
    several = store.write("several", several)
    classes = surrounded.join(several, "seed", "left_semi")
    classes = store.write("classes", classes.select("seed", "around", F.xxhash64("seed", "around").alias("class"), F.col("head.id").alias("low"), F.col("head.at").alias("at"), "high"))
    heads = classes.groupBy(F.col("low").alias("id")).agg(F.collect_list(F.struct("class", "at")).alias("heads"))
    # one row of an id that several rows have
    passages = extended(texts.join(heads, "id").select("text", "heads"), length, seed)
    passages = store.write("passages", passages)
    ends = classes.select("class", "low", "high")
    known = passages.join(ends, "class")
    twice = known.groupBy("passage").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first <> last").select("passage", "first")
    found = passages.join(twice, "passage").groupBy("class").agg(F.collect_set(F.struct("back", "first")).alias("backs"))
    found = store.write("found", classes.select("seed", "around", "class").join(found, "class").drop("class"))
    of_class = matched.join(found, ["seed", "around"])
    at = F.col("at")
    some = of_class.select("id", F.transform("backs", lambda x: F.struct((at - x["back"]).alias("start"), (at - x["back"] + length).alias("end"), (x["first"] < F.col("id")).alias("later"))).alias("spans"))
    alone = matched.join(several, "seed", "left_anti").filter(F.col("left") + F.col("right") >= length)
    unbroken = alone.select("id", F.array(F.struct((at - F.col("left")).alias("start"), (at + F.col("right")).alias("end"), (F.col("run_low") < F.col("id")).alias("later"))).alias("spans"))
    spans = some.unionByName(unbroken).groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    counted = whole.filter("seed is null").select(F.col("id").alias("of"), F.col("at").cast("long").alias("n_words"))
    result = counted.join(merged(spans), F.col("of") == F.col("id"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return result.select(F.col("of").alias(id_column), "n_words", zero("n_repeated_words"), zero("n_later_words"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("later_spans", F.lit("")).alias("later_spans"))


def op10_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
