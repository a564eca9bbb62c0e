"""Token counts of whole texts by a two-tier look-up of pre-token lengths.

A byte-level BPE encodes each pre-token on its own, so a text's count is the sum of its pre-tokens' lengths. Tasks cut
texts into pre-tokens with array operations and look each different one of a chunk up, first in a broadcast table of
the pre-tokens that the vocabulary itself holds (two arrays of at most the vocabulary's size, which bounds the
broadcast), then in a cache that lives as long as the Python worker. What neither knows is encoded by the tokenizer's
library and cached. Nothing is shuffled: one map over the texts.

Texts that hold the string of a special token, or a character whose class differs between versions of Unicode, are
given whole to the library. Null counts as empty (0 bytes, 0 tokens); repeated rows each get their row; an empty table
gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebeat.llm import kernel
from placebeat.llm.support import narrow, ship, table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CACHE_ENTRIES = 1_000_000
LETTER, NUMBER, OTHER, BLANK = range(4)
UNSURE = 4
#: The contractions that the vocabulary's pattern cuts off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Pictographs, newer than the version of Unicode that all libraries share, but no letters, numbers or blanks in any.
PICTURES = (0x1F300, 0x1FAFF)
BLANKS = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """Class of every code point; UNSURE where versions of Unicode may differ."""
    out = np.full(0x110000, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    for code in (*range(0x30000), *range(0xE0000, 0x110000)):
        kind = old.category(chr(code))
        if kind not in ("Cn", "Cs") and kind[0] == unicodedata.category(chr(code))[0]:
            out[code] = {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
    out[PICTURES[0] : PICTURES[1] + 1] = OTHER
    out[[*range(0x09, 0x0E), 0x20, *BLANKS]] = BLANK
    return out


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def encoded_lengths(path: str, texts: list[str]) -> list[int]:
    return [len(x) for x in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


def pretoken_starts(codes: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; offsets: where the texts begin, and the end."""
    n = len(codes)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    turn = first[:n].copy()
    turn[1:] |= kinds[1:] != kinds[:-1]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (codes[:-1] == 0x20) & ~first[1:n]
    blank = kinds == BLANK
    starts = turn & (blank | ~after_blank)
    # the last blank before other characters stands alone, or goes with them if it is a space
    last = blank.copy()
    last[:-1] &= turn[1:]
    last[-1:] = False
    starts |= last & ~first[1:]
    quote = np.flatnonzero((codes == 0x27) & starts & turn)
    if len(quote):
        padded, ends = np.append(codes, [0, 0, 0]), np.append(first, [True, True, True])
        kind = np.append(kinds, [BLANK, BLANK, BLANK])
        for short in CONTRACTIONS:
            at, fits = quote, np.ones(len(quote), bool)
            for k, letter in enumerate(short[1:], 1):
                fits &= (padded[at + k] == ord(letter)) & ~ends[at + k]
            at = at[fits]
            starts[at + 1] = False
            behind = at + len(short)
            goes_on = (kind[behind] == LETTER) & ~ends[behind]
            starts[behind[goes_on]] = True
    return starts


class Lengths:
    """Lengths of pre-tokens by their hash: the broadcast table first, then the worker's cache."""

    def __init__(self, path: str) -> None:
        self.path, self.cache = path, {}

    def look_up(self, keys: np.ndarray, known: tuple[np.ndarray, np.ndarray], spell) -> np.ndarray:
        hashes, sizes = known
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        hit = hashes[at] == keys
        out = np.where(hit, sizes[at], 0).astype(np.int64)
        rest = np.flatnonzero(~hit)
        names = keys[rest].tolist()
        if len(self.cache) + len(rest) > CACHE_ENTRIES:
            self.cache.clear()
        cached = self.cache
        miss = [k for k, name in enumerate(names) if name not in cached]
        if miss:
            lengths = encoded_lengths(self.path, [spell(rest[k]) for k in miss])
            cached.update(zip((names[k] for k in miss), lengths, strict=True))
        out[rest] = [cached[name] for name in names]
        return out


@cache
def lengths_of(path: str) -> Lengths:
    return Lengths(path)


def chunk_counts(data: np.ndarray, offsets: np.ndarray, path: str, known, special: tuple[bytes, ...]) -> np.ndarray:
    """Tokens of each text of a chunk."""
    rows = len(offsets) - 1
    whole = np.zeros(rows, bool)
    raw = data.tobytes()
    for mark in special:
        at = raw.find(mark)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            whole[row] |= at + len(mark) <= offsets[row + 1]
            at = raw.find(mark, at + 1)
    lead = (data & 0xC0) != 0x80
    codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counts = np.zeros(rows, np.int64)
    if len(codes) == int(lead.sum()):
        place = np.flatnonzero(lead)
        text_starts = np.searchsorted(place, offsets)
        kinds = classes()[codes]
        whole |= kernel.per_row(kinds == UNSURE, text_starts) > 0
        starts = np.flatnonzero(pretoken_starts(codes, kinds, text_starts))
        row = np.searchsorted(text_starts, starts, "right") - 1
        begin = place[starts]
        end = np.append(begin[1:], len(data))
        keys = kernel.Prefix(kernel._BYTES[data]).spans(begin, end)
        keep = ~whole[row]
        different, one, back = np.unique(keys[keep], return_index=True, return_inverse=True)
        begin, end = begin[keep][one], end[keep][one]
        sizes = lengths_of(path).look_up(different, known, lambda k: raw[begin[k] : end[k]].decode("utf-8", "replace"))
        counts += np.bincount(row[keep], weights=sizes[back], minlength=rows).astype(np.int64)
    else:  # bytes that aren't UTF-8
        whole[:] = True
    for k in np.flatnonzero(whole):
        text = raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")
        counts[k] = encoded_lengths(path, [text])[0]
    return counts


def vocabulary_lengths(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of the vocabulary's entries that are one pre-token: the frequent ones, by how it was made."""
    tok = tokenizer(path)
    entries = [tok.decode([k]) for k in range(tok.get_vocab_size(with_added_tokens=False))]
    texts = sorted({x for x in entries if x and "�" not in x and len(tok.pre_tokenizer.pre_tokenize_str(x)) == 1})
    joined = b"".join(x.encode() for x in texts)
    ends = np.cumsum([len(x.encode()) for x in texts])
    hashes = kernel.Prefix(kernel._BYTES[np.frombuffer(joined, np.uint8)]).spans(np.append(0, ends[:-1]), ends)
    order = np.argsort(hashes)
    return hashes[order], np.array(encoded_lengths(path, texts), np.uint8)[order]


def token_counts(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """id, n_bytes and n_tokens of every text, as the library counts them without begin and end tokens.

    path names the JSON file of a byte-level BPE tokenizer; executors must reach it there.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    spark = frame.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(vocabulary_lengths(path))
    special = tuple(x.content.encode() for x in tokenizer(path).get_added_tokens_decoder().values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _, _, data, offsets in kernel.chunks(batch.column(1)):
                found.append(chunk_counts(data, offsets, path, known.value, special))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(found))], ["id", "n_bytes", "n_tokens"])

    texts = narrow(frame, id=id_column, text=text_column)
    kind = texts.schema["id"].dataType.simpleString()
    texts = texts.select("id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return texts.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
