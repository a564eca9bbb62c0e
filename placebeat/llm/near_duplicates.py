"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A text's set holds the hashes of its distinct shingles of ``size`` words, A-Z lower-cased; a shorter text is one shingle.
Its sketch is filled in rounds: in each of the first t rounds every shingle is placed in a random one of t bins, in round
t + i every shingle in bin i, and a bin keeps the smallest (round, hash) it gets; rounds end when all bins are filled,
which one or two do for long texts. Every coordinate is filled, equals another set's with probability J, and the share of
equal ones concentrates like that of t independent draws.

Texts with equal sets are one class from here on. Classes that share a band of r coordinates are candidates:

1. Each member of a band's bucket is paired with the bucket's first class in one order of all classes, so a group of n near copies gives about n pairs and not n * n. Pairs are verified on full sets.
2. Where a bucket still holds different components, all its pairs across components are verified too. Pairs inside a
   component aren't needed: they can't change it. So no pair of different components that shares a band is left out.

The joins that make pairs drop those whose set sizes rule the similarity out, and those whose sketches differ in more
coordinates (two bits of each) than a pair at the threshold does within four standard deviations; a pair comes from the
first bucket it shares. A bucket's first class is the one that meets most others in its buckets, which of a text and its
copies is the text. With 72
bands of 7, a pair at similarity 0.75 shares no band with probability 3e-5, at 0.8 with 3e-8; texts that share a passage
and are 0.3 alike are candidates in one of 60 cases.

Null texts and texts without words have an empty set and are linked with nothing; equal texts are linked; rows with a
null id can't be named and are left out; repeated rows each get their row; an empty table gives no rows; columns other
than those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebeat.llm import kernel
from placebeat.llm.components import components
from placebeat.llm.support import narrow, ship, stage, table
from placebeat.plans.stage import Stage

U = np.uint64
SHINGLE_WORDS = 5
BANDS, ROWS = 72, 7
LONGS, PLANES = 8, 2  # of 64 coordinates each; coordinates beyond them have no bit
DEVIATIONS = 4
BITS = tuple(f"bits{k}" for k in range(LONGS * PLANES))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text of a chunk, by row."""
    words = kernel.Words(data, offsets)
    prefix = kernel.Prefix(words.hashes(fold=True))
    at = words.windows(size)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    row = np.concatenate((words.row[at], short))
    hashes = np.concatenate((prefix.spans(at, at + size), prefix.spans(words.first[short], words.first[short + 1])))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def sketches(row: np.ndarray, hashes: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """A sketch of each set, rows x bins; sets must be ordered by row. Empty sets keep the largest number."""
    top = np.iinfo(U).max
    out = np.full(rows * bins, top, U)
    count = np.bincount(row, minlength=rows)
    for turn in range(2 * bins):
        g = kernel.mix(hashes + U((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        value = (U(turn) << U(48)) | (g >> U(16))
        if turn < bins:
            slot = row * bins + ((g & U(0xFFFF)) * U(bins) >> U(16)).astype(np.int64)
        else:
            slot = row * bins + (turn - bins)
        np.minimum.at(out, slot, value)
        missing = (out.reshape(rows, bins) == top).any(axis=1) & (count > 0)
        keep = missing[row]
        if not keep.any():
            break
        row, hashes = row[keep], hashes[keep]
    return out.reshape(rows, bins)


def sketched(texts: DataFrame, size: int, bands: int, per_band: int) -> DataFrame:
    """id, n_shingles, the set's two-part signature, a key for each band and two bits of each coordinate, in planes."""
    ship(texts.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, behind, data, offsets in kernel.chunks(batch.column(1)):
                rows = behind - begin
                row, hashes = shingle_sets(data, offsets, size)
                coordinates = sketches(row, hashes, rows, bands * per_band)
                parts = kernel.mix(coordinates).reshape(rows, bands, per_band)
                keys = np.zeros((rows, bands), U)
                for k in range(per_band):
                    keys = kernel.mix(keys + parts[:, :, k])
                keys = kernel.mix(keys + np.arange(bands, dtype=U) * U(0xD1342543DE82EF95)).view(np.int64)
                edges = np.searchsorted(row, np.arange(rows + 1))
                sums = [np.append(U(0), np.cumsum(kernel.mix(hashes + U(salt)), dtype=U)) for salt in (1, 2)]
                marks = [(s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums]
                mixed = kernel.mix(coordinates)[:, : 64 * LONGS]
                bits = []
                for plane in range(PLANES):
                    flags = np.zeros((rows, 64 * LONGS), np.uint8)
                    flags[:, : mixed.shape[1]] = mixed >> U(63 - plane) & U(1)
                    bits.append(np.packbits(flags, axis=1).view(np.int64))
                bits = np.concatenate(bits, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, rows),
                        pa.array(np.diff(edges).astype(np.int64)),
                        pa.array(marks[0]),
                        pa.array(marks[1]),
                        pa.ListArray.from_arrays(np.arange(0, rows * bands + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1))),
                        *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(LONGS * PLANES)),
                    ],
                    ["id", "n_shingles", "mark1", "mark2", "band_keys", *BITS],
                )

    return texts.mapInArrow(sketch, "id long, n_shingles long, mark1 long, mark2 long, band_keys array<bigint>, " + ", ".join(f"{x} long" for x in BITS))


def most_different(percent: int, coordinates: int) -> int:
    """Different coordinates that a pair at the threshold has within DEVIATIONS standard deviations."""
    n, share = min(coordinates, 64 * LONGS), (1 - percent / 100) * (1 - 0.5**PLANES)
    return math.ceil(n * share + DEVIATIONS * math.sqrt(n * share * (1 - share)))


def alike(a: str, b: str, percent: int, most: int) -> Column:
    """Whether the sizes and sketches under two aliases allow the similarity."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    different = F.lit(0)
    for k in range(LONGS):
        planes = [F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}")) for name in BITS[k::LONGS]]
        either = planes[0]
        for plane in planes[1:]:
            either = either.bitwiseOR(plane)
        different = different + F.bit_count(either)
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & (different <= most)


def merged_with(frame: DataFrame) -> DataFrame:
    """The side of a join whose size follows the corpus: sorted and merged on small tables too, so that plans don't change with size."""
    return frame.hint("merge")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    joined = texts.toDF("b", "text_b").join(merged_with(pairs), "b").join(merged_with(texts.toDF("a", "text_a")), "a").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            bytes_of = np.cumsum(np.add(*(np.asarray(pc.binary_length(batch.column(k)).fill_null(0)).astype(np.int64) for k in (2, 3))))
            while begin < batch.num_rows:  # slices of bounded size
                before = bytes_of[begin - 1] if begin else 0
                behind = max(begin + 1, int(np.searchsorted(bytes_of, before + kernel.CHUNK_BYTES, "right")))
                part = batch.slice(begin, behind - begin)
                sets = []
                for column in (part.column(2), part.column(3)):
                    found = [(row + first, hashes) for first, _, data, offsets in kernel.chunks(column) for row, hashes in [shingle_sets(data, offsets, size)]]
                    sets.append([np.concatenate(x) for x in zip(*found, strict=True)])
                (row_a, set_a), (row_b, set_b) = sets
                row, both = np.concatenate((row_a, row_b)), np.concatenate((set_a, set_b))
                order = np.lexsort((both, row))
                row, both = row[order], both[order]
                common = np.bincount(row[1:][(row[1:] == row[:-1]) & (both[1:] == both[:-1])], minlength=part.num_rows)
                union = np.bincount(row, minlength=part.num_rows) - common
                keep = pa.array((100 * common >= percent * union) & (common > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], ["a", "b"])
                begin = behind

    return joined.mapInArrow(check, "a long, b long")


def near_duplicate_links(
    texts: DataFrame, store: Stage, size: int, percent: int, bands: int, per_band: int
) -> tuple[DataFrame, DataFrame]:
    """All documents as (id, n_shingles, class), and (node, root) of the classes that have links.

    A class is the smallest id of the texts with the same set; empty sets are classes of their own.
    """
    most = most_different(percent, bands * per_band)
    every = store.write("sketches", sketched(texts, size, bands, per_band))
    sets = every.filter("n_shingles > 0").groupBy("n_shingles", "mark1", "mark2").agg(F.min("id").alias("class"))
    sets = store.write("sets", sets)  # a table, so that Spark can split a large group of equal sets in the join
    classes = store.write("classes", every.select("id", "n_shingles", "mark1", "mark2").join(merged_with(sets), ["n_shingles", "mark1", "mark2"], "left").select("id", "n_shingles", F.coalesce("class", "id").alias("class")))
    heads = classes.filter("id = class and n_shingles > 0").select("id")
    banded = every.select("id", "band_keys").join(merged_with(heads), "id", "left_semi").select("id", F.explode("band_keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = store.write("buckets", banded.join(merged_with(shared), "key"))
    met = buckets.groupBy("id").agg(F.sum(F.col("n") - 1).alias("met"), F.array_sort(F.collect_list("key")).alias("keys"))  # at most a key for each band
    members = store.write("members", every.select("id", "n_shingles", *BITS).join(merged_with(met), "id"))
    used = store.write("texts", texts.join(merged_with(members.select("id")), "id", "left_semi"))
    ordered = buckets.select("key", "id").join(members.select("id", "met"), "id")
    centers = ordered.groupBy("key").agg(F.max(F.struct("met", F.xxhash64("id").alias("turn"), "id"))["id"].alias("center"))
    stars = buckets.select("key", "id").join(centers, "key").filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(merged_with(members.alias("x")), F.col("a") == F.col("x.id")).join(merged_with(members.alias("y")), (F.col("b") == F.col("y.id")) & alike("x", "y", percent, most))
    stars = store.write("stars", stars.select("a", "b"))
    links = store.write("links", verified(stars, used, size, percent))
    roots = components(links, store, "first")
    # pairs across components
    placed = buckets.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    rest = store.write("mixed", placed.join(mixed, "key", "left_semi").join(members.drop("met"), "id"))
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    across = rest.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & alike("x", "y", percent, most) & once)
    across = across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    tried = stars.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    across = store.write("across", across.join(tried, (F.least("a", "b") == F.col("p")) & (F.greatest("a", "b") == F.col("q")), "left_anti"))
    more = store.write("more", verified(across, used, size, percent))
    return classes, components(links.union(more), store, "all")


def near_duplicates(
    frame: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SHINGLE_WORDS,
    percent: int = 75,
    bands: int = BANDS,
    per_band: int = ROWS,
    store: Stage | None = None,
) -> DataFrame:
    """id, n_shingles, component_id (smallest id of its component) and kept (whether it is that one) of each document.

    The result reads tables of the store; a caller that gives one may close it once the result is written.
    """
    store = store or stage(frame.sparkSession)
    texts = narrow(frame, id=id_column, text=text_column).filter("id is not null").select(F.col("id").cast("long").alias("id"), "text")
    classes, roots = near_duplicate_links(texts, store, size, percent, bands, per_band)
    placed = classes.join(roots.withColumnRenamed("node", "class"), "class", "left")
    component = F.coalesce("root", "class")
    return placed.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
