"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into pieces of at most ``PIECE`` words; the words of the pieces (A-Z lower-cased, without ASCII
punctuation) are the terms. Documents are read as overlapping windows in three lengths, and a piece is compared with the
windows of the length next to its own. Three passes over the documents, each a map whose output is small:

1. document frequencies of the terms over all windows, for the weights; a piece's terms are those in at most
   ``common`` of the windows, and if these are few, its rarest,
2. a randomised singular value decomposition of the TF-IDF matrix of all windows: every task adds up its rows' part of
   A'(A W) for a random W with as many columns as the space has dimensions, tasks sum the parts by blocks of terms, and
   the factors follow from the sum, whose size is that of the block's terms and not of the documents,
3. windows and pieces are projected into the space; pairs with a cosine of at least ``least_cosine`` are candidates, all of
   them. Those whose window holds less than ``least_shared`` of the piece's weight (a coincidence of the projection) go;
   the others are verified beside the text: the longest common subsequence of the piece and the words around the window
   must hold ``verbatim`` of the piece, or ``paraphrase`` of it and as much of the words of its last sentence, the answer.

The benchmark is worked on in blocks of a bounded number of bytes, as what tasks get of it (terms, factors, pieces) is
broadcast. Items of one word, null and empty items match nothing; null and empty texts hold nothing; rows with a null id
can't be named and are left out; repeated rows and items give one pair of ids; empty tables give no rows; columns other
than those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebeat.llm import kernel
from placebeat.plans.stage import Stage
from placebeat.llm.support import narrow, ship, stage, table

PIECE = 64
LENGTHS = (16, 32, 64)
BLOCK = 8  # words; half of the shortest window
BLOCK_BYTES = 400_000
TERM_BLOCK = 256
U = np.uint64


@dataclass
class Pieces:
    """The pieces of a block of items: ids of their items, words, numbers of their terms, and lengths' index."""

    items: list[int]
    words: list[np.ndarray]  # hashes of all words, in order
    answers: list[np.ndarray]  # different hashes of the last sentence's words
    scale: np.ndarray
    terms: np.ndarray  # hashes, ascending


def folded(texts: list[str]) -> tuple[kernel.Words, np.ndarray]:
    column = pa.array(texts, pa.string())
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(x.encode()) for x in texts])) if len(column) else np.zeros(1, np.int64)
    words = kernel.Words(data, offsets, kernel.MARKS)
    return words, words.hashes(fold=True)


def cut(rows: list[tuple[int, str]]) -> Pieces:
    """Pieces of items (id, text)."""
    items, pieces, answers = [], [], []
    words, hashes = folded([text or "" for _, text in rows])
    ends = (words.data == ord(".")) | (words.data == ord("?")) | (words.data == ord("!"))
    stops = np.append(0, np.cumsum(ends))
    for k, (item, _) in enumerate(rows):
        first, behind = words.first[k], words.first[k + 1]
        parts = max(1, math.ceil((behind - first) / PIECE))
        edges = np.linspace(first, behind, parts + 1).round().astype(int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            breaks = np.flatnonzero(stops[words.start[a + 1 : b]] > stops[words.end[a : b - 1]])
            answer = a + breaks[-1] + 1 if len(breaks) else a + (b - a) // 2
            items.append(item)
            pieces.append(hashes[a:b])
            answers.append(np.unique(hashes[answer:b]))
    scale = np.array([next((k for k, size in enumerate(LENGTHS) if size >= 0.75 * len(x)), len(LENGTHS) - 1) for x in pieces], int)
    return Pieces(items, pieces, answers, scale, np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, U))


def positions(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Number of each hash among the ascending terms; -1 for those that are none."""
    if not len(terms):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at, -1)


def window_starts(words: kernel.Words, size: int) -> np.ndarray:
    """Where windows of so many words begin: every half window of each row, the last one shorter; none for empty rows."""
    step = size // 2
    each = np.where(words.count > 0, 1 + np.maximum(0, -(-(words.count - size) // step)), 0)
    row = np.repeat(np.arange(len(each)), each)
    turn = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    return words.first[row] + turn * step


def window_ends(words: kernel.Words, starts: np.ndarray, size: int) -> np.ndarray:
    return np.minimum(starts + size, words.first[words.row[starts] + 1]) if len(starts) else starts


def window_terms(words: kernel.Words, term: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, term, times) of the terms in windows, and the windows' starts."""
    starts = window_starts(words, size)
    ends = window_ends(words, starts, size)
    hits = np.flatnonzero(term >= 0)
    low, high = np.searchsorted(hits, starts), np.searchsorted(hits, ends)
    n = high - low
    window = np.repeat(np.arange(len(starts)), n)
    at = hits[np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    width = int(term.max()) + 1 if len(hits) else 1
    pairs, times = np.unique(window * width + term[at], return_counts=True)
    return pairs // width, pairs % width, times, starts


def frequencies(texts: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many windows of the middle length each term is, and the number of windows."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in kernel.chunks(batch.column(1)):
                words = kernel.Words(data, offsets, kernel.MARKS)
                _, term, _, starts = window_terms(words, positions(words.hashes(fold=True), known), LENGTHS[1])
                sums[:-1] += np.bincount(term, minlength=len(known))
                sums[-1] += len(starts)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], ["term", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    for row in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out[:-1], int(out[-1])


def weights(pieces: Pieces, counts: np.ndarray, windows: int, common: float, few: int) -> np.ndarray:
    """Weight of every term: its inverse frequency if it is rare, or among the rarest ``few`` of a piece that has less rare ones."""
    inverse = np.log((windows + 1) / (counts + 1)) + 1e-3
    chosen = counts <= common * windows
    for words in pieces.words:
        own = positions(np.unique(words), pieces.terms)
        if chosen[own].sum() < few:
            chosen[own[np.argsort(counts[own], kind="stable")[:few]]] = True
    return np.where(chosen, inverse, 0.0)


class Blocks:
    """A chunk's words in blocks of ``BLOCK``; each row is followed by empty ones, so that windows don't reach the next."""

    def __init__(self, words: kernel.Words, term: np.ndarray) -> None:
        """term: the number of each word's term, -1 for none."""
        self.words = words
        self.spare = LENGTHS[-1] // BLOCK - 1
        each = -(-words.count // BLOCK) + self.spare
        self.first = np.cumsum(each) - each
        self.total = int(each.sum()) + self.spare
        self.hits = np.flatnonzero(term >= 0)
        row = words.row[self.hits]
        self.term = term[self.hits]
        self.block = self.first[row] + (self.hits - words.first[row]) // BLOCK

    def sums(self, matrix: np.ndarray) -> np.ndarray:
        """Sums, by block, of the rows of a matrix that belong to the block's terms."""
        out = np.zeros((self.total, *matrix.shape[1:]), matrix.dtype)
        turn = np.arange(len(self.block)) - np.searchsorted(self.block, self.block)
        for k in range(BLOCK):
            at = np.flatnonzero(turn == k)
            if not len(at):
                break
            out[self.block[at]] += matrix[self.term[at]]
        return out

    def starts(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and first blocks of windows of so many words: every half window of each row."""
        words = window_starts(self.words, size)
        row = self.words.row[words] if len(words) else words
        return words, self.first[row] + (words - self.words.first[row]) // BLOCK


def doubled(sums: np.ndarray, blocks: int) -> np.ndarray:
    """Sums of twice as many blocks from each block on, from those of so many."""
    out = sums.copy()
    out[:-blocks] += sums[blocks:]
    return out


def rare_terms(hashes: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the words' terms that have a weight, else -1."""
    term = positions(hashes, terms)
    term[(term >= 0) & (weight[term] == 0)] = -1
    return term


def projection(texts: DataFrame, pieces: Pieces, weight: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Right singular vectors (terms x dimensions) of the TF-IDF matrix of all windows and pieces, from one pass.

    A window's row is divided by its length, taken over the words (a repeated term counts as two).
    """
    n = len(pieces.terms)
    columns = min(dimensions, n)
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, columns)))[0].astype(np.float32)
    shared = texts.sparkSession.sparkContext.broadcast((pieces.terms, weight, omega))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight, omega = shared.value
        weighted, squared = (omega * weight[:, None]).astype(np.float32), weight**2
        sums = np.zeros(omega.shape, np.float64)
        half = LENGTHS[1] // 2 // BLOCK
        for batch in batches:
            for _, _, data, offsets in kernel.chunks(batch.column(1)):
                words = kernel.Words(data, offsets, kernel.MARKS)
                blocks = Blocks(words, rare_terms(words.hashes(fold=True), terms, weight))
                if not len(blocks.hits):
                    continue
                product, norm = blocks.sums(weighted), blocks.sums(squared)
                for k in range((2 * half).bit_length() - 1):
                    product, norm = doubled(product, 1 << k), doubled(norm, 1 << k)
                _, at = blocks.starts(LENGTHS[1])
                rows = product[at] / np.maximum(norm[at], 1e-12)[:, None]
                # what the windows over a half window add up to, at its first block
                over = np.zeros_like(product)
                over[at] += rows
                over[at + half] += rows
                own = blocks.block - (blocks.block - blocks.first[words.row[blocks.hits]]) % half
                order = np.argsort(blocks.term, kind="stable")
                for k in range(0, len(order), 100_000):
                    o = order[k : k + 100_000]
                    t = blocks.term[o]
                    edge = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
                    sums[t[edge]] += np.add.reduceat(over[own[o]], edge, axis=0)
        sums *= weight[:, None]
        for block in range(0, len(terms), TERM_BLOCK):
            part = sums[block : block + TERM_BLOCK].astype(np.float32)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        for block, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    total = np.zeros((n, columns))
    parts = texts.mapInArrow(sketch, "block long, part binary").repartition("block").mapInArrow(add, "block long, part binary")
    for row in parts.collect():  # the block's terms x dimensions
        part = np.frombuffer(row["part"], np.float64).reshape(-1, columns)
        total[row["block"] : row["block"] + len(part)] += part
    piece, term, value = piece_rows(pieces, weight)
    seen = added_up(np.zeros((len(pieces.words), columns)), piece, omega, term, value)
    order = np.argsort(term, kind="stable")
    added_up(total, term[order], seen, piece[order], value[order])
    # eigenvectors of A'A from its product with omega (Nystroem)
    shift = 1e-9 * max(np.linalg.norm(total), 1e-9)
    moved = total + shift * omega
    core = omega.T @ moved
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-10 * max(values.max(initial=0), 1e-300)
    half = moved @ (vectors[:, good] / np.sqrt(values[good]))
    left, sizes, _ = np.linalg.svd(half, full_matrices=False)
    return left[:, sizes > 1e-6 * sizes.max(initial=0)].astype(np.float32)


def piece_rows(pieces: Pieces, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of the pieces, of length 1: (piece, term, value) of what isn't zero, by piece and term."""
    found = [np.unique(words, return_counts=True) for words in pieces.words]
    piece = np.repeat(np.arange(len(found)), [len(own) for own, _ in found])
    term = positions(np.concatenate([own for own, _ in found]), pieces.terms)
    order = np.lexsort((term, piece))
    piece, term, value = piece[order], term[order], np.concatenate([times for _, times in found])[order] * weight[term[order]]
    held = value != 0
    piece, term, value = piece[held], term[held], value[held]
    norm = np.sqrt(np.bincount(piece, weights=value * value, minlength=len(found)))
    return piece, term, value / np.maximum(norm[piece], 1e-12)


def added_up(out: np.ndarray, at: np.ndarray, source: np.ndarray, of: np.ndarray, value: np.ndarray) -> np.ndarray:
    """out[at] += value * source[of], a bounded number of entries at a time; ``at`` must ascend."""
    for k in range(0, len(at), 50_000):
        own = at[k : k + 50_000]
        edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[edge]] += np.add.reduceat(value[k : k + 50_000, None] * source[of[k : k + 50_000]], edge, axis=0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def common_subsequence(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence, with the bits of a number as the row of the table."""
    row = full = (1 << length) - 1
    for word in words:
        mask = masks.get(word)
        if mask:
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return length - row.bit_count()


def held_share(term, low, high, piece, held, share_of, terms: int) -> np.ndarray:
    """For windows given by their hits (from low to high) and pieces: what share of a piece's weight the window's terms hold.

    held: ascending piece * terms + term of all pieces, share_of: their shares. A repeated term counts again.
    """
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    key = piece[of] * terms + term[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    at = np.minimum(np.searchsorted(held, key), len(held) - 1)
    return np.bincount(of, weights=np.where(held[at] == key, share_of[at], 0.0), minlength=len(n))


def verify(pieces: Pieces, piece: int, masks, hashes, start: int, size: int, first: int, behind: int, paraphrase: float) -> tuple[float, float]:
    """Shares of a piece and of its answer that the words around a window hold."""
    words = pieces.words[piece]
    length = len(words)
    if piece not in masks:
        bits: dict[int, int] = {}
        for k, x in enumerate(words.tolist()):
            bits[x] = bits.get(x, 0) | 1 << k
        masks[piece] = bits
    region = hashes[max(first, start - length // 2) : min(behind, start + size + length // 2)]
    share = common_subsequence(masks[piece], length, region.tolist()) / length
    return share, float(np.isin(pieces.answers[piece], region).mean()) if share >= paraphrase else 0.0


def leaks_of_block(texts: DataFrame, pieces: Pieces, weight, space, least_cosine, least_shared, verbatim, paraphrase) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of verified candidates, possibly several for a pair."""
    piece, term, value = piece_rows(pieces, weight)
    latent = unit(added_up(np.zeros((len(pieces.words), space.shape[1])), piece, space, term, value)).astype(np.float32)
    shares = value**2
    sent = (pieces, weight, (space * weight[:, None]).astype(np.float32), latent, piece * len(pieces.terms) + term, shares)
    shared = texts.sparkSession.sparkContext.broadcast(sent)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weight, weighted, latent, held, share_of = shared.value
        of_scale = [np.flatnonzero(pieces.scale == k) for k in range(len(LENGTHS))]
        masks: dict[int, dict[int, int]] = {}
        for batch in batches:
            out: list[tuple[int, int, float, float, float]] = []
            for begin, _, data, offsets in kernel.chunks(batch.column(1)):
                words = kernel.Words(data, offsets, kernel.MARKS)
                hashes = words.hashes(fold=True)
                blocks = Blocks(words, rare_terms(hashes, pieces.terms, weight))
                if not len(blocks.hits):
                    continue
                sums, reach = blocks.sums(weighted), 1
                seen: set[tuple[int, int, float]] = set()
                for size, own in zip(LENGTHS, of_scale, strict=True):
                    while reach * BLOCK < size:
                        sums, reach = doubled(sums, reach), 2 * reach
                    starts, at = blocks.starts(size)
                    low = np.searchsorted(blocks.hits, starts)
                    high = np.searchsorted(blocks.hits, window_ends(words, starts, size))
                    some = np.flatnonzero(high > low)
                    for k in range(0, len(some) if len(own) else 0, 8192):
                        part = some[k : k + 8192]
                        cosines = unit(sums[at[part]]) @ latent[own].T
                        w, p = np.nonzero(cosines >= least_cosine)
                        window, piece = part[w], own[p]
                        shared_ = held_share(blocks.term, low[window], high[window], piece, held, share_of, len(pieces.terms))
                        for c in np.flatnonzero(shared_ >= least_shared).tolist():
                            start, own_piece = int(starts[window[c]]), int(piece[c])
                            row = int(words.row[start])
                            share, answer = verify(pieces, own_piece, masks, hashes, start, size, int(words.first[row]), int(words.first[row + 1]), paraphrase)
                            if share >= verbatim or share >= paraphrase and answer >= paraphrase:
                                found = (row, own_piece, round(share, 3))
                                if found not in seen:
                                    seen.add(found)
                                    out.append((begin + row, own_piece, float(cosines[w[c], p[c]]), share, answer))
            rows = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([pieces.items[x[1]] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.float64()) for k in (2, 3, 4))],
                ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"],
            )

    return texts.mapInArrow(search, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")


def decontamination(
    frame: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    dimensions: int = 128,
    common: float = 0.005,
    few: int = 8,
    least_cosine: float = 0.3,
    least_shared: float = 0.2,
    verbatim: float = 0.8,
    paraphrase: float = 0.6,
    seed: int = 11,
    store: Stage | None = None,
) -> DataFrame:
    """One row for each document and benchmark item it leaks: ids, best cosine, LCS share and answer share.

    The result reads tables of the store; a caller that gives one may close it once the result is written.
    """
    ship(frame.sparkSession)
    store = store or stage(frame.sparkSession)
    texts = narrow(frame, id=id_column, text=text_column).filter("id is not null").select(F.col("id").cast("long").alias("id"), "text")
    items = narrow(benchmark, id=item_column, text=item_text_column).filter("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()
        pieces = cut([(r["id"], r["text"]) for r in rows])
        if not len(pieces.terms):
            continue
        counts, windows = frequencies(texts, pieces.terms)
        weight = weights(pieces, counts, windows, common, few)
        space = projection(texts, pieces, weight, dimensions, seed)
        part = store.write(f"leaks-{block}", leaks_of_block(texts, pieces, weight, space, least_cosine, least_shared, verbatim, paraphrase))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return frame.sparkSession.createDataFrame([], f"{id_column} long, {item_column} long, cosine double, lcs_share double, answer_share double")
    best = found.groupBy("doc_id", "item_id").agg(*(F.max(x).alias(x) for x in ("cosine", "lcs_share", "answer_share")))
    return best.withColumnsRenamed({"doc_id": id_column, "item_id": item_column})


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
