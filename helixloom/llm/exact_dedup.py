"""Exact deduplication by Grace hash partitioning: bounded open-addressing tables that compare complete contents.

Rows are first collapsed within their input partition (a hot text leaves a task once), then dealt into buckets by a hash of the
whole text; the shuffle files and the level's table in the shared folder are the spill files. A bucket's task keeps contents in a
table of bounded bytes. Once the table is full, a content that is not in it goes on to the next level, where another hash deals it
anew; a content that is in the table keeps absorbing its copies, so what a level settles is final. Levels run until nothing is left.

Null texts count as empty; a null doc_id never wins against another, and of rows that repeat the winning doc_id one is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, write_table

FIT = 64 << 20  # bytes of distinct contents that a bucket's table holds
COLLAPSE = 16 << 20  # the same for the collapse within an input partition
ROW_COST = 200  # bytes of an entry beside its content


class ContentTable:
    """Open addressing with linear probing; equal hashes are told apart by their complete contents."""

    def __init__(self, limit: int):
        self.limit, self.bytes, self.mask = limit, 0, 1023
        self.slots = [-1] * 1024
        self.keys: list[int] = []
        self.texts: list[bytes] = []
        self.rows: list[int] = []
        self.best: list = []
        self.ties: list[int] = []

    def find(self, key: int, text: bytes) -> tuple[int, int]:
        """(entry or -1, the slot that ended the search)"""
        s = (key ^ key >> 32) & self.mask
        while (e := self.slots[s]) >= 0:
            if self.keys[e] == key and self.texts[e] == text:
                return e, s
            s = s + 1 & self.mask
        return -1, s

    def add(self, key: int, text: bytes, rows: int, best, ties: int) -> bool:
        """Count the row in; False if its content is new and the table is full. An empty table takes any content."""
        e, s = self.find(key, text)
        if e >= 0:
            self.rows[e] += rows
            old = self.best[e]
            if old == best:
                self.ties[e] += ties
            elif old is None or best is not None and best > old:
                self.best[e], self.ties[e] = best, ties
            return True
        if self.keys and self.bytes + len(text) + ROW_COST > self.limit:
            return False
        self.slots[s] = len(self.keys)
        for column, value in ((self.keys, key), (self.texts, text), (self.rows, rows), (self.best, best), (self.ties, ties)):
            column.append(value)
        self.bytes += len(text) + ROW_COST
        if 2 * len(self.keys) > self.mask:
            self.grow()
        return True

    def grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for e, key in enumerate(self.keys):
            s = (key ^ key >> 32) & self.mask
            while self.slots[s] >= 0:
                s = s + 1 & self.mask
            self.slots[s] = e


def _batches(schema: pa.Schema, rows: Iterator[tuple], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += 100 + len(r[1] or b"")
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):  # few Python objects at a time
            yield from zip(*(c.slice(lo, 512).to_pylist() for c in b.columns))


def _collapse(limit: int):
    """Rows (h, text, rows, best, ties) of a partition with copies collapsed, as far as they meet in one table."""

    def run(batches):
        schema = None

        def rows():
            table = ContentTable(limit)
            for r in _rows(taken()):
                if not table.add(*r):
                    yield from zip(table.keys, table.texts, table.rows, table.best, table.ties)
                    table = ContentTable(limit)
                    table.add(*r)
            yield from zip(table.keys, table.texts, table.rows, table.best, table.ties)

        def taken():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        held = rows()
        first = next(held, None)
        if first is not None:
            yield from _batches(schema, _chain(first, held))

    return run


def _chain(first, rest):
    yield first
    yield from rest


def _settle(limit: int):
    """Rows (h, text, rows, best, ties, sha): a settled content has its digest and no text, one that goes on has its text."""

    def run(batches):
        schema = None
        table = ContentTable(limit)

        def over():
            nonlocal schema
            for b in batches:
                schema = schema or b.schema.append(pa.field("sha", pa.string()))
                for r in _rows(iter([b])):
                    if not table.add(*r):
                        yield (*r, None)

        def settled():
            for key, text, rows, best, ties in zip(table.keys, table.texts, table.rows, table.best, table.ties):
                yield key, None, rows, best, ties, hashlib.sha256(text).hexdigest()

        held = over()
        first = next(held, None)
        if first is not None:
            yield from _batches(schema, _chain(first, held))
        if table.keys:
            yield from _batches(schema, settled())

    return run


def content_groups(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, fit: int = FIT, collapse: int = COLLAPSE, buckets: int | None = None) -> DataFrame:
    """One row for each distinct text: its hash h, rows, the largest doc_id (best), the rows that have it (ties) and sha.

    ``key`` hashes the text; contents with equal keys stay apart. Buckets follow the bytes of the texts, so that a table is about
    a quarter full; a worse guess only makes more levels.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    text = text_of().cast("binary")
    form = f"h long, text binary, rows long, best {kind}, ties long"
    rows = docs.select(key(text).cast("long").alias("h"), text.alias("text"), F.lit(1).cast("long").alias("rows"), F.col("doc_id").alias("best"), F.lit(1).cast("long").alias("ties"))
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(text_of()) + ROW_COST)).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * size // fit)
    rows, level, done = rows.mapInArrow(_collapse(collapse), form), 0, None
    while True:
        dealt = F.pmod(F.xxhash64(F.lit(level), "text"), F.lit(buckets)).cast("int")
        out = write_table(rows.repartitionById(buckets, dealt).mapInArrow(_settle(fit), f"{form}, sha string"))
        settled = out.where("sha IS NOT NULL").drop("text")
        done = settled if done is None else done.unionByName(settled)
        rest = out.where("sha IS NULL").drop("sha")
        if rest.isEmpty():
            return done
        rows, level = rest.mapInArrow(_collapse(collapse), form), level + 1


def deduplicate(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, **sizes) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row. The groups return to their rows by the text's hash; texts
    whose hash another text shares (next to none) are grouped once more on the whole text instead."""
    groups = write_table(content_groups(docs, key, **sizes))
    clashing = groups.groupBy("h").count().where("count > 1").select("h")
    rows = docs.select(key(text_of().cast("binary")).cast("long").alias("h"), "doc_id")
    nth = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("h", "doc_id").orderBy(F.lit(1))))
    if clashing.isEmpty():
        out = nth.join(groups, "h")
    else:
        clashing = write_table(clashing)
        texts = docs.select(key(text_of().cast("binary")).cast("long").alias("h"), "doc_id", text_of().alias("_text")).join(clashing, "h", "left_semi")
        per = texts.groupBy("_text", "doc_id").agg(F.count("*").alias("_n"))
        own = per.groupBy("_text").agg(F.sum("_n").alias("rows"), F.max("doc_id").alias("best"))
        again = texts.withColumn("_nth", F.row_number().over(Window.partitionBy("_text", "doc_id").orderBy(F.lit(1)))).join(own, "_text")
        out = nth.join(groups.join(clashing, "h", "left_anti"), "h").select("doc_id", "_nth", "best", "rows", "sha").unionByName(
            again.select("doc_id", "_nth", "best", "rows", F.sha2(F.col("_text").cast("binary"), 256).alias("sha")))
    kept = F.col("doc_id").eqNullSafe(F.col("best")) & (F.col("_nth") == 1)
    return out.select("doc_id", F.col("best").alias("keep_id"), F.col("rows").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
