"""Quality rules from tokeniser fertility.

Each word of a text is encoded by a public SentencePiece vocabulary with byte fallback (pieces don't cross blanks, so a
text's pieces are those of its words). Three measures come of it: characters per token, the share of byte-fallback
tokens and the entropy of the text's tokens in bits. A text outside the bands of its language is rejected; a language
without bands takes those of the script that most of its letters have. Four counts of words, symbols, repeated lines and
repeated word windows are reported beside them, and reject very short and repetitive texts.

One map over the texts, nothing is shuffled. Words that a worker has met are looked up in its cache, which is emptied
when it holds ``CACHE_WORDS``. Null and empty texts have all counts 0, null measures and are rejected (too few words);
repeated rows each get their row; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebeat.llm import kernel
from placebeat.llm.support import fresh, narrow, ship, table

CACHE_WORDS = 200_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(x) for x in "#*$%&|<>"]] = True
#: (least characters per token, most byte-fallback share, least and most entropy in bits) by language, then by script.
BANDS = {
    "en": (2.0, 0.02, 5.3, 12.5),
    "de": (2.04, 0.03, 5.3, 12.5),
    "fr": (1.74, 0.03, 5.3, 12.5),
    "es": (1.80, 0.03, 5.3, 12.5),
    "latin": (1.65, 0.05, 4.0, 12.5),
    "cyrillic": (1.3, 0.05, 4.0, 12.5),
    "han": (0.5, 0.6, 4.0, 12.5),
    "other": (0.25, 0.97, 3.0, 12.5),
}
SCRIPTS = ("latin", "cyrillic", "han", "other")


@cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """Pieces of words by the words' hashes, in one array that grows until the cache is emptied."""

    def __init__(self, path: str) -> None:
        self.model = processor(path)
        self.fallback = np.array([self.model.is_byte(k) for k in range(self.model.vocab_size())])
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.begin, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def look_up(self, keys: np.ndarray, spell) -> np.ndarray:
        """Rows of begin and size, by key."""
        names = keys.tolist()
        if len(self.place) + len(names) > CACHE_WORDS:
            self.clear()
        place = self.place
        miss = [k for k, name in enumerate(names) if name not in place]
        if miss:
            found = self.model.encode([spell(k) for k in miss], num_threads=1)
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((x for ids in found for x in ids), np.uint16, int(sizes.sum()))
            n = len(place)
            if n + len(miss) > len(self.begin):
                room = 2 * (n + len(miss))
                self.begin, self.size = np.resize(self.begin, room), np.resize(self.size, room)
            if self.used + len(flat) > len(self.ids):
                self.ids = np.resize(self.ids, 2 * (self.used + len(flat)))
            self.begin[n : n + len(miss)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(miss)] = sizes
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            place.update(zip((names[k] for k in miss), range(n, n + len(miss)), strict=True))
        return np.array([place[name] for name in names], np.int64)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def entropy(tokens: np.ndarray) -> float:
    """Bits of the distribution of a text's tokens."""
    ordered = np.sort(tokens, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])))
    share = np.diff(edges) / len(tokens)
    return float(-(share * np.log2(share)).sum())


def base_counts(words: kernel.Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk that need no vocabulary."""
    data, offsets = words.data, words.offsets
    rows = len(offsets) - 1
    lead = ((data & 0xC0) != 0x80) & ~kernel.SPACE[data]
    # lines: the spans between newlines and ends of texts that hold a word
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    end = end[: len(begin)]
    end = end - (data[end - 1] == 0x0A)
    holds = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[holds], end[holds]
    line_row = np.searchsorted(offsets, begin, "right") - 1
    lines = kernel.Prefix(kernel._BYTES[data]).spans(begin, end)
    different = np.unique(np.stack((line_row.astype(np.uint64), lines)), axis=1)[0] if len(lines) else np.zeros(0)
    # words inside windows that are found again
    at = words.windows(3)
    inside = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        again = at[kernel.repeated(kernel.Prefix(hashes).spans(at, at + 3), words.row[at])]
        np.add.at(inside, again, 1)
        np.add.at(inside, again + 3, -1)
    covered = np.cumsum(inside)[:-1] > 0
    return {
        "n_words": words.count,
        "word_chars": kernel.per_row(lead, offsets),
        "n_symbols": kernel.per_row(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(line_row, minlength=rows) - np.bincount(different.astype(np.int64), minlength=rows),
        "n_repeat_words": kernel.per_row(covered, words.first),
    }


def fertility(words: kernel.Words, hashes: np.ndarray, path: str) -> dict[str, np.ndarray]:
    """Tokens, byte-fallback tokens and token entropy of each text of a chunk."""
    known, raw, rows = pieces(path), words.data.tobytes(), len(words.count)
    different, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    begin, end = words.start[one], words.end[one]
    at = known.look_up(different, lambda k: raw[begin[k] : end[k]].decode("utf-8", "replace"))[back]
    size = known.size[at].astype(np.int64)
    behind = np.cumsum(size)
    source = np.repeat(known.begin[at] - (behind - size), size) + np.arange(int(behind[-1]) if len(behind) else 0)
    tokens = known.ids[source]
    edges = np.append(0, behind)[words.first]
    bits = np.array([entropy(tokens[a:b]) if b > a else np.nan for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return {"n_tokens": np.diff(edges), "n_byte_tokens": kernel.per_row(known.fallback[tokens], edges), "token_entropy": bits.reshape(rows)}


def script_index(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index into SCRIPTS of what most letters of each text are, by their lead bytes."""
    latin = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) | (data >= 0xC3) & (data <= 0xC9)
    cyrillic = (data >= 0xD0) & (data <= 0xD3)
    han = (data >= 0xE4) & (data <= 0xE9)
    other = (data >= 0xCA) & ~cyrillic & ~han & (data != 0xE2)
    return np.argmax([kernel.per_row(x, offsets) for x in (latin, cyrillic, han, other)], axis=0)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "token_entropy")


def measures(data: np.ndarray, offsets: np.ndarray, path: str) -> dict[str, np.ndarray]:
    words = kernel.Words(data, offsets)
    hashes = words.hashes()
    return base_counts(words, hashes) | fertility(words, hashes, path) | {"script": script_index(data, offsets)}


def text_measures(frame: DataFrame, text_column: str = "text", path: str | None = None, name: str = "measures") -> DataFrame:
    """The frame's columns and the struct ``name`` (MEASURES and ``script``), one row for each row."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    ship(frame.sparkSession)
    at = frame.columns.index(text_column)
    kind = "struct<" + ", ".join(f"{x}: {'double' if x == 'token_entropy' else 'bigint'}" for x in MEASURES) + ", script: string>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(data, offsets, path) for _, _, data, offsets in kernel.chunks(batch.column(at))]
            if not found:
                continue
            whole = {k: np.concatenate([x[k] for x in found]) for k in (*MEASURES, "script")}
            fields = [pa.array(whole[k].astype(np.int64)) for k in MEASURES[:-1]]
            fields += [pa.array(whole["token_entropy"], from_pandas=True), pa.array(np.array(SCRIPTS)[whole["script"]], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(fields, [*MEASURES, "script"])], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(measure, f"{fields}, `{name}` {kind}")


def verdicts(measured: Column, lang: Column, bands: dict[str, tuple[float, float, float, float]]) -> dict[str, Column]:
    """chars_per_token, byte_share, base_failed and kept of a struct of measures and a language (null: by script)."""
    n = measured["n_tokens"]
    table_of = F.create_map(*(x for k, v in bands.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    band = F.coalesce(table_of[lang], table_of[measured["script"]])
    chars_per_token, byte_share = F.when(n > 0, measured["word_chars"] / n), F.when(n > 0, measured["n_byte_tokens"] / n)
    entropy_ = measured["token_entropy"]
    inside = (chars_per_token >= band[0]) & (byte_share <= band[1]) & (entropy_ >= band[2]) & (entropy_ <= band[3])
    failed = (measured["n_words"] < 50) | (100 * measured["n_repeat_words"] > 50 * measured["n_words"])
    return {"chars_per_token": chars_per_token, "byte_share": byte_share, "base_failed": failed, "kept": ~failed & F.coalesce(inside, F.lit(False))}


def quality_rules(
    frame: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str | None = "lang",
    path: str | None = None,
    bands: dict[str, tuple[float, float, float, float]] = BANDS,
) -> DataFrame:
    """Counts, measures and the verdict ``kept`` of every text.

    bands: by language or script, (least characters per token, most byte share, least and most entropy). Null languages
    and those without bands go by script.
    """
    named = {"id": id_column, "text": text_column} | ({"lang": lang_column} if lang_column else {})
    texts = narrow(frame, **named)
    if not lang_column:
        texts = texts.withColumn("lang", F.lit(None).cast("string"))
    found = text_measures(texts.select("id", "lang", "text"), "text", path).drop("text")
    judged = found.select("id", "measures.*", *(c.alias(k) for k, c in verdicts(F.col("measures"), F.col("lang"), bands).items()))
    return judged.withColumnRenamed("id", id_column)


def passing(frame: DataFrame, text_column: str = "text", lang_column: str = "lang", path: str | None = None, bands=BANDS) -> DataFrame:
    """The rows of the frame whose text is kept, with all their columns."""
    name = fresh(frame, "measures")
    found = text_measures(frame, text_column, path, name)
    return found.filter(verdicts(F.col(f"`{name}`"), F.col(f"`{lang_column}`"), bands)["kept"]).select(*(F.col(f"`{x}`") for x in frame.columns))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
