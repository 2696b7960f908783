"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII white space characters."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def write_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back: cuts the lineage,
    survives lost executors, and later reads take only the columns they need."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of_text(text: str | None) -> list[bytes]:
    """Words of an ASCII-lower-cased text as UTF-8; bytes.split() cuts at exactly the six ASCII white space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """word -> XXH64; a bounded memo kept by the worker process."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


class Bitmap:
    """A fixed number of bits over 64-bit hashes: no false negatives, and a size that never grows."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @classmethod
    def of(cls, hashes: DataFrame, col: str, log2: int) -> Bitmap:
        """Set on the executors with Spark's bitmap aggregate; at most 2**log2 bits reach the driver."""
        slot = F.col(col).bitwiseAND((1 << log2) - 1) + 1  # from 1 on, buckets are aligned
        parts = hashes.select(slot.alias("_slot")).groupBy(F.bitmap_bucket_number("_slot").alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_m"))
        bits = np.zeros(max(1 << log2, 1 << 15) // 8, np.uint8)
        for r in parts.collect():
            at = (r["_b"] - 1) * 4096
            bits[at:at + 4096] = np.frombuffer(bytes(r["_m"]), np.uint8)
        return cls(bits, log2)

    def __contains__(self, h: int) -> bool:
        s = h & ((1 << self.log2) - 1)
        return bool(self.bits[s >> 3] >> (s & 7) & 1)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        s = (hashes & np.uint64((1 << self.log2) - 1)).astype(np.int64)
        return (self.bits[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)

