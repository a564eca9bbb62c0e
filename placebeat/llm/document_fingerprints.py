"""Document fingerprints from closed syncmers, and their likeness by the places of common anchors.

A text's words are hashed in pairs. A stretch of K words is an anchor (a closed syncmer) if the smallest of its pairs' hashes
is that of its first or its last pair. That depends on the stretch alone and not on its surroundings, so an edit moves no
anchor but those it touches; about 2 in 7 stretches are anchors, and two that follow each other begin at most K - S words
apart. The fingerprint lists all anchors of the whole text in order: for each, one hexadecimal digit for the words since the
one before (the first: since the beginning) and eight for its hash; a last digit gives the words from the last anchor's
first to the end.

Likeness compares places, not only hashes: two neighbouring anchors with the distance between them, and the outer ones with
their distance to the text's ends, form a link; likeness is the number of different links in both over that in either. So
anchors count as common where they lie equally far from a common neighbour, wherever the passage stands in the text.

Null texts count as empty; a text without words has the empty fingerprint, one of fewer than K words, or of a few more
and without an anchor, a single anchor of all its words; two empty fingerprints are alike (1), an empty and another one are not (0). The next document of one id is that of
the next lower id, after the lowest the highest; of several texts of that id, the one with the smallest hash. Rows that
share an id have the same next document; rows with a null id stand in no order, and their next document is empty. Each row
gets its row; an empty table gives no rows; columns other than those named are not read. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebeat.llm.mixing import with_rank
from placebeat.llm.support import narrow, stage, table
from placebeat.plans.stage import Stage

K, S = 8, 2  # words of a stretch and of its inner pieces
BLANKS = r"[\x20\x09-\x0D]+"
RECORD = 9  # characters of an anchor in a fingerprint
SALTS = 64  # parts that rows of one id are spread over


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def hashed(mark: Column) -> Column:
    """Eight hexadecimal digits of a hash."""
    return F.lpad(F.lower(F.hex(mark.bitwiseAND(0xFFFFFFFF))), 8, "0")


def digit(n: Column) -> Column:
    return F.lower(F.hex(n.cast("long")))


def anchored(pairs: Column, at: Column) -> Column:
    """Whether the stretch at ``at`` is a closed syncmer."""
    edge, inner = K - S, [F.get(pairs, at + k) for k in range(1, K - S)]
    return F.least(F.get(pairs, at), F.get(pairs, at + edge)) <= F.least(*inner)


def record(pairs: Column, places: Column, k: Column) -> Column:
    at = F.get(places, k)
    since = at - F.when(k > 0, F.get(places, k - 1)).otherwise(0)
    return F.concat(digit(since), hashed(F.xxhash64(*(F.get(pairs, at + j) for j in range(0, K - S + 1, S)))))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; empty for null and for texts without words."""

    def of_pairs(words: Column) -> Callable[[Column], Column]:
        def build(pairs: Column) -> Column:
            places = F.filter(F.sequence(F.lit(0), F.size(words) - K), lambda i: anchored(pairs, i))
            listed = lambda p: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda k: record(pairs, p, k)), ""), digit(F.size(words) - F.get(p, F.size(p) - 1)))
            return let(places, lambda p: F.when(F.size(p) == 0, alone(words)).otherwise(listed(p)))

        return build

    def alone(words: Column) -> Column:
        return F.concat(F.lit("0"), hashed(F.xxhash64(F.array_join(words, " "))), digit(F.size(words)))

    def build(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(words) - S), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
        return F.when(F.size(words) == 0, "").when(F.size(words) < K, alone(words)).otherwise(let(pairs, of_pairs(words)))

    return let(F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != ""), build)


def links(mark: Column) -> Column:
    """Hashes of the links of a fingerprint: each distance with the anchors on both sides of it."""

    def listed(data: Column) -> Column:
        count = F.floor(F.octet_length(data) / RECORD).cast("int")
        first = F.xxhash64(F.lit("first"), F.substring(data, 1, RECORD))
        middle = F.transform(F.sequence(F.lit(2), count), lambda k: F.xxhash64(F.substring(data, k * RECORD - 16, 17)))
        last = F.xxhash64(F.lit("last"), F.substring(data, count * RECORD - 7, RECORD))
        return F.when(count == 0, F.array().cast("array<bigint>")).when(count == 1, F.array(first, last)).otherwise(F.concat(F.array(first, last), middle))

    return let(mark.cast("binary"), listed)  # substrings of bytes don't walk the whole text


def likeness(a: Column, b: Column) -> Column:
    """Share of common links of two lists of links; 1 if both are empty."""
    common = lambda b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return let(b, lambda b: F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common(b)))


def packed(mark: Column) -> Column:
    """A fingerprint in half as many bytes."""
    return F.unhex(mark)


def unpacked(data: Column) -> Column:
    """The fingerprint again: without the zero that packing puts before an odd number of digits."""
    return let(F.lower(F.hex(data)), lambda text: F.when(F.octet_length(text) % RECORD == 2, F.substring(text, 2, 1 << 30)).otherwise(text))


def salt(mark: Column) -> Column:
    return mark.bitwiseAND(SALTS - 1).cast("int")


def order(texts: DataFrame, store: Stage) -> DataFrame:
    """For each id: mark (the hash of the text that stands for it), serves (the id whose next document it is), need (the most
    code points that one takes) and parts (as bits, the salts of that one's rows)."""
    mark = F.xxhash64("text")
    ids = texts.filter("id is not null").groupBy("id").agg(
        F.min(mark).alias("mark"), F.max(F.floor(F.length("text") / 2)).alias("need"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt(mark))).alias("parts")
    )
    ranked = store.write("ranked", with_rank(ids, "id", store))
    count = ranked.count()
    served = ranked.select(F.col("id").alias("serves"), "need", "parts", F.pmod(F.col("rank") - 1, F.lit(max(count, 1))).alias("rank"))
    return store.write("order", ranked.select("id", "mark", "rank").join(served, "rank").drop("rank"))


def document_fingerprints(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_chars, fingerprint, edited (the text with its second half replaced by the next document's beginning),
    edited_fingerprint, next_fingerprint, near_edited and near_next of every document."""
    store = stage(frame.sparkSession)
    texts = narrow(frame, id=id_column, text=text_column).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    follows = order(texts, store)
    named = texts.filter("id is not null").withColumn("salt", salt(F.xxhash64("text")))
    # Each text is shuffled once, by id; its beginning and packed fingerprint once more, to the document before it. Both branches
    # select the same columns under the same filter up to the shuffle, so Spark reads one shuffle twice.
    sent = named.join(follows.withColumn("salt", salt(F.col("mark"))).withColumnRenamed("mark", "of"), ["id", "salt"])
    sent = sent.filter(F.xxhash64("text").bitwiseXOR(F.col("of")) == 0)
    part = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.expr("parts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0))
    sent = sent.select(F.col("serves").alias("id"), part.alias("salt"), F.expr("left(text, cast(need as int))").alias("beginning"), packed(fingerprint(F.col("text"))).alias("next_mark"))
    sent = sent.groupBy("id", "salt").agg(F.first("beginning").alias("beginning"), F.first("next_mark").alias("next_mark"))  # equal rows of one id
    met = named.join(sent, ["id", "salt"], "left").drop("salt")
    met = met.unionByName(texts.filter("id is null").withColumns({"beginning": F.lit(""), "next_mark": F.unhex(F.lit(""))}))
    met = met.select("id", "text", "beginning", fingerprint(F.col("text")).alias("mark"), unpacked(F.col("next_mark")).alias("next_mark"))
    half = F.expr("cast(floor(length(text) / 2) as int)")
    met = met.withColumns({"n_chars": F.length("text").cast("long"), "edited": F.concat(F.call_function("left", F.col("text"), F.length("text") - half), F.call_function("left", F.col("beginning"), half))})
    met = met.select("id", "n_chars", "mark", "edited", fingerprint(F.col("edited")).alias("edited_mark"), "next_mark")
    near = let(links(F.col("mark")), lambda own: F.struct(likeness(own, links(F.col("edited_mark"))).alias("edited"), likeness(own, links(F.col("next_mark"))).alias("next")))
    met = met.withColumn("near", near)
    return met.select(
        F.col("id").alias(id_column), "n_chars", F.col("mark").alias("fingerprint"), "edited", F.col("edited_mark").alias("edited_fingerprint"),
        F.col("next_mark").alias("next_fingerprint"), F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"),
    )


def op12_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = document_fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
