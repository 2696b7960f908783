"""Benchmark decontamination with spaced seeds.

A fixed mask looks at some token positions and ignores the others, so a substitution under an ignored position leaves the hash
as it was. Test and training hashes meet in an equi-join; around each hit the two texts are laid over each other without gaps and
a window passes if at least 80 % of its tokens agree. The masks of a window length are lossless: for every way to place the
allowed substitutions, one of them fits beside them (tests/llm checks all ways), so no passing window is missed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import cut_lineage
from .common import Bitmap, hash_words, text_of, words_of_text

WINDOW = 20
# window length from which it holds: token positions of its masks. Items below 10 tokens must agree in all.
MASKS = {
    10: [(0, 1, 2, 4), (0, 1, 4, 6)],
    15: [(0, 1, 3, 4, 5), (0, 1, 2, 3, 4)],
    20: [(0, 1, 3, 4, 5, 6), (0, 1, 5, 7, 8, 9), (0, 1, 5, 7, 8, 11)],
}
BITMAP_LOG2 = 26  # 8 MB
SPAN = StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("agree", IntegerType()), StructField("item_first", IntegerType())])


def rule(n_tokens: int) -> tuple[int, int]:
    """(window, substitutions allowed in it) for an item of so many tokens."""
    w = min(n_tokens, WINDOW)
    return w, w // 5 if w >= 10 else 0


def masks_of(n_tokens: int) -> list[tuple[int, ...]]:
    w, _ = rule(n_tokens)
    if w < 10:
        return [tuple(range(w))]
    return MASKS[max(k for k in MASKS if k <= w)]


_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(WINDOW)], np.uint64)


def mask_hashes(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for each position at which the mask's span fits."""
    n = len(tokens) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, sum(1 << p for p in mask), np.uint64)
    for p in mask:
        h += tokens[p:p + n] * _ODD[p]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _seeds_of(masks, bitmap=None, piece: int = 1 << 18):
    """mapInPandas body: (key, text) rows to (h, key, pos) seeds, at the positions that the bitmap may hold."""

    def found(keys, toks):
        flat = np.concatenate(toks)
        ends = np.cumsum([len(t) for t in toks])
        for m in masks:
            h = mask_hashes(flat, m)
            at = np.flatnonzero(bitmap.value.hits(h)) if bitmap is not None else np.arange(len(h))
            doc = np.searchsorted(ends, at, "right")
            inside = at + m[-1] < ends[doc] if len(at) else np.zeros(0, bool)
            at, doc = at[inside], doc[inside]
            starts = ends[doc] - np.array([len(toks[d]) for d in doc], np.int64) if len(at) else at
            yield pd.DataFrame({"h": h[at].view(np.int64), "key": [keys[d] for d in doc], "pos": (at - starts).astype(np.int32)})

    def run(frames):
        for f in frames:
            keys, toks, size = [], [], 0
            for k, t in zip(f["key"], f["text"]):
                w = words_of_text(t)
                if w:
                    keys.append(k)
                    toks.append(hash_words(w))
                    size += len(w)
                if size >= piece:
                    yield from found(keys, toks)
                    keys, toks, size = [], [], 0
            if keys:
                yield from found(keys, toks)

    return run


def _item_seeds(frames):
    for f in frames:
        out = []
        for i, t in zip(f["item"], f["text"]):
            tok = hash_words(words_of_text(t))
            for m in masks_of(len(tok)) if len(tok) else []:
                out += [(int(h), i, p) for p, h in enumerate(mask_hashes(tok, m).view(np.int64))]
        yield pd.DataFrame(out, columns=["h", "item", "ipos"])


def seed_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (key, item, diag): training text ``key`` and test text ``item`` share a seed with the item's first token at
    position ``diag`` of the training text. ``docs`` has key and text, ``items`` item and text."""
    spark = docs.sparkSession
    sizes = [r[0] for r in items.select(F.least(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(WINDOW)).alias("n")).distinct().collect()]  # at most 20 numbers
    masks = sorted({m for n in sizes if n for m in masks_of(n)})
    test = cut_lineage(items.mapInPandas(_item_seeds, "h long, item binary, ipos int"))
    bitmap = spark.sparkContext.broadcast(Bitmap.of(test, "h", BITMAP_LOG2))
    train = docs.mapInPandas(_seeds_of(masks, bitmap), "h long, key binary, pos int")
    return train.join(test, "h").select("key", "item", (F.col("pos") - F.col("ipos")).alias("diag")).distinct()


def overlap(doc: list[bytes], item: list[bytes], diag: int) -> tuple[int, int, int, int] | None:
    """The passing stretch of one laying: (first, last) token in the document, tokens that agree, first token in the item; None if no
    window passes. The stretch runs from the first passing window's start to the last one's end."""
    w, k = rule(len(item))
    lo, hi = max(0, -diag), min(len(item), len(doc) - diag)
    if w == 0 or hi - lo < w:
        return None
    same = np.fromiter((doc[diag + j] == item[j] for j in range(lo, hi)), np.int64, hi - lo)
    sums = np.concatenate(([0], np.cumsum(same)))
    ok = np.flatnonzero(sums[w:] - sums[:-w] >= w - k)
    if not len(ok):
        return None
    a, b = int(ok[0]), int(ok[-1]) + w
    return diag + lo + a, diag + lo + b - 1, int(sums[b] - sums[a]), lo + a


@F.pandas_udf(SPAN)
def best_overlap_udf(texts: pd.Series, items: pd.Series, diags: pd.Series) -> pd.DataFrame:
    """The overlap with most agreeing tokens, then the first in the document."""
    out, last = [], (None, [])
    for t, i, ds in zip(texts, items, diags):
        if last[0] is not t:
            last = (t, words_of_text(t))
        item = words_of_text(i)
        found = [o for o in (overlap(last[1], item, int(d)) for d in ds) if o]
        out.append(min(found, key=lambda o: (-o[2], o[0], o[3])) if found else (None,) * 4)
    return pd.DataFrame(out, columns=SPAN.names).astype("Int32")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    t = text_of(F.col(f"`{text}`"))
    return docs.withColumn("_key", F.unhex(F.md5(t))).withColumn("_text", t)


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_key, item_id, first, last, agree, item_first): for each training text, known by its MD5, and each test item the best
    passing overlap. Equal texts are searched as often as they occur but verified once.

    A null or empty text overlaps nothing. Equal items under several ids are each reported, repeated (id, text) rows once; a null item id is reported as null.
    Hot texts and frequent passages only add rows to a join that adaptive execution may split: no group is collected but the
    layings of one text and one item.
    """
    t = text_of(F.col(f"`{item_text}`"))
    names = items.select(F.col(f"`{item_id}`").alias("item_id"), F.unhex(F.md5(t)).alias("item"), t.alias("itext")).distinct()
    tests = names.select("item", "itext").distinct()
    rows = _keyed(docs, text)
    hits = cut_lineage(seed_hits(rows.select(F.col("_key").alias("key"), F.col("_text").alias("text")), tests.select("item", F.col("itext").alias("text"))))
    layings = hits.groupBy("key", "item").agg(F.sort_array(F.collect_list("diag")).alias("diags")).join(tests, "item").withColumnRenamed("key", "_key")
    texts = rows.join(hits.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi").groupBy("_key").agg(F.first("_text").alias("_text"))
    found = texts.join(layings, "_key").select("_key", "item", best_overlap_udf("_text", "itext", "diags").alias("o")).where("o.first IS NOT NULL")
    return cut_lineage(found.join(names.select("item_id", "item"), "item").select("_key", "item_id", "o.first", "o.last", "o.agree", "o.item_first"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """(doc_id, item_id, first, last, agree, item_first) for every row of ``docs`` and every item it overlaps."""
    found = overlaps(docs, items, text, **kw)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.md5(text_of(F.col(f"`{text}`")))).alias("_key"))
    return rows.join(found, "_key").select("doc_id", "item_id", "first", "last", "agree", "item_first")


def decontam_stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a passing overlap, with the columns they came with."""
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    bad = overlaps(named, items, at["text"]).select("_key").distinct()
    return named.withColumn("_key", F.unhex(F.md5(text_of(F.col(at["text"]))))).join(bad, "_key", "left_anti").select(*[F.col(v).alias(c) for c, v in at.items()])
