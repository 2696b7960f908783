"""Target-distribution importance resampling: hashed word runs, bucket gains against a target, and a Gumbel draw.

CRC-32 is linear up to a constant of the length: crc(m) = XOR over the bytes of T[distance from the end][byte], XOR crc(zero
bytes). So a batch's words are hashed at once: look up every byte's contribution, XOR over spans by ``bitwise_xor.reduceat``.
Spans longer than the table fold blockwise: blocks of ``POSITIONS`` bytes, then blocks of blocks, advanced by their distance.

Null texts count as empty, a null doc_id draws as the text ``2024:``; repeated rows are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from .common import text_of, write_table

POSITIONS = 64
PIECE = 1 << 20  # bytes hashed at once, a bound on a task's memory
LENGTHS = np.array([zlib.crc32(bytes(n)) for n in range(1024)], np.uint32)
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = (_BYTES >= 128) | (_BYTES >= 48) & (_BYTES <= 57) | (_BYTES >= 97) & (_BYTES <= 122)


def _byte_positions() -> np.ndarray:
    """[distance from the end, byte] -> contribution."""
    t = np.empty((POSITIONS, 256), np.uint32)
    for d in range(POSITIONS):
        zero = zlib.crc32(bytes(d + 1))
        t[d] = [zlib.crc32(bytes([b]) + bytes(d)) ^ zero for b in range(256)]
    return t


BYTE_AT = _byte_positions()


def _spread(columns: list[int]) -> np.ndarray:
    """A linear map given by the images of the 32 bits, as tables for the four bytes of a register."""
    out = np.zeros((4, 256), np.uint32)
    for bit, image in enumerate(columns):
        out[bit // 8, (_BYTES >> (bit % 8) & 1).astype(bool)] ^= np.uint32(image)
    return out


def _through(tables: np.ndarray, r: np.ndarray) -> np.ndarray:
    return tables[..., 0, r & 255] ^ tables[..., 1, r >> 8 & 255] ^ tables[..., 2, r >> 16 & 255] ^ tables[..., 3, r >> 24]


@lru_cache(maxsize=8)
def block_positions(level: int) -> np.ndarray:
    """[distance in blocks, byte of the register, value]: a block's register carried over the blocks after it."""
    bits = step = np.uint32(1) << np.arange(32, dtype=np.uint32)
    below = None if level == 1 else _spread(list(_through(block_positions(level - 1)[1], bits)))
    for _ in range(POSITIONS):  # a register over one zero byte, or over one block of the level below
        step = step >> np.uint32(8) ^ BYTE_AT[0][step & 255] if below is None else _through(below, step)
    one = _spread(list(step))
    tables, at = np.empty((POSITIONS, 4, 256), np.uint32), bits
    for j in range(POSITIONS):
        tables[j] = _spread(list(at))
        at = _through(one, at)
    return tables


def span_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:start + length] for every span; spans may overlap, none is empty."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    sizes, values, level = lengths, None, 0
    while True:
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        back = np.repeat(sizes, sizes) - 1 - place  # from the end of the span
        near = back % POSITIONS
        if level == 0:
            part = BYTE_AT[near, data[np.repeat(starts, sizes) + place]]
        else:
            t = block_positions(level)
            part = t[near, 0, values & 255] ^ t[near, 1, values >> 8 & 255] ^ t[near, 2, values >> 16 & 255] ^ t[near, 3, values >> 24]
        values = np.bitwise_xor.reduceat(part, np.flatnonzero((near == POSITIONS - 1) | (place == 0)))
        sizes, level = -(-sizes // POSITIONS), level + 1
        if sizes.max() == 1:
            break
    short = lengths < len(LENGTHS)
    values ^= np.where(short, LENGTHS[np.where(short, lengths, 0)], 0).astype(np.uint32)
    for i in np.flatnonzero(~short):
        values[i] ^= np.uint32(zlib.crc32(bytes(int(lengths[i]))))
    return values


def word_runs(offsets: np.ndarray, data: np.ndarray, runs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, crc) of every run of 1 to ``runs`` words of the texts, in pieces; words of a run are joined by one space."""
    inside = IN_WORD[LOWER[data]]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & (~before | edge[:-1]))
    if not len(first):
        return
    after = np.concatenate([inside[1:], [False]])
    size = np.flatnonzero(inside & (~after | edge[1:])) + 1 - first
    row = np.searchsorted(offsets, first, "right") - 1
    at = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    joined = np.full(int(at[-1] + size[-1]), 32, np.uint8)
    joined[np.flatnonzero(inside) - np.repeat(first - at, size)] = LOWER[data[inside]]
    for n in range(1, runs + 1):
        if n > len(first):
            return
        same = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1])
        length = at[same + n - 1] + size[same + n - 1] - at[same]
        piece = np.cumsum(length) // PIECE
        for cut in np.split(np.arange(len(same)), np.flatnonzero(np.diff(piece)) + 1):
            if len(cut):
                yield row[same[cut]], span_crcs(joined, at[same[cut]], length[cut])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the batch's rows of about ``PIECE`` bytes: first row, end row, offsets, bytes."""
    text = batch.column("text").cast(pa.large_binary())
    _, where, held = text.buffers()
    offsets = np.frombuffer(where, np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(held or b"", np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1)
        yield lo, hi, offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]]
        lo = hi


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; a task sends one row for each bucket that it has met, so at most ``buckets`` rows."""

    def count(batches):
        seen = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, offsets, data in _texts(b):
                for _, crc in word_runs(offsets, data, runs):
                    seen += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "c"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text_of().alias("text")).mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[r["bucket"]] = r["c"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(smoothed target share / smoothed corpus share)) for each bucket."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + b)) / float((s + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int) -> DataFrame:
    """doc_id, n_words, n_features and the floored mean gain of the features (0 without any)."""
    buckets = np.uint32(len(gain))

    def rows(batches):
        for b in batches:
            words, total, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, hi, offsets, data in _texts(b):
                done = 0
                for row, crc in word_runs(offsets, data, runs):
                    total[lo:hi] += np.bincount(row, minlength=hi - lo)
                    weight[lo:hi] += np.bincount(row, gain[crc % buckets], hi - lo).astype(np.int64)
                    done += 1
                # without longer runs every feature is a word
                words[lo:hi] = total[lo:hi] if runs == 1 else word_counts(offsets, data)
            weight = np.floor_divide(weight, np.maximum(total, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(total), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(rows, f"doc_id {kind}, n_words long, n_features long, weight long")


def word_counts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    inside = IN_WORD[LOWER[data]]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | edge[:-1]))
    np.add.at(out, np.searchsorted(offsets, first, "right") - 1, 1)
    return out


def resample(docs: DataFrame, target: DataFrame, runs: int = 2, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """Every document with its weight, its Gumbel score and, if drawn, its rank: the ``percent`` % highest scores of the documents
    with ``least`` words or more, which is a draw without replacement in proportion to exp(weight / 1000).

    Two passes over the texts (bucket counts, weights); only ``buckets`` counts reach the driver. Ranks are numbered over range
    partitions, so no task holds all scores.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    done = write_table(weigh(docs, gain, runs).withColumn("score", F.col("weight") + noise))
    take = done.where(F.col("n_words") >= least).count() * percent // 100
    placed = number_rows(done, [], [F.col("n_words") < least, F.desc("score"), F.asc_nulls_last("doc_id")], "_place")
    rank = F.when((F.col("n_words") >= least) & (F.col("_place") <= take), F.col("_place").cast("long"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")
