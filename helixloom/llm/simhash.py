"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets the table of its Hamming distances to fixed reference fingerprints. By the triangle inequality
two fingerprints at most ``MAX_BITS`` apart differ by at most that in every coordinate, so a pair is discarded by its largest
coordinate difference and only survivors are verified. A table of distances alone has no join key, so pairs meet by blocks:
of BLOCKS bit blocks at most MAX_BITS can differ, hence some BLOCKS - MAX_BITS agree, and each pair is taken only under the
first such set. A block set with more than ``BUCKET`` fingerprints is not paired: its members meet at the fingerprints within
two flips of the other bits, which is exact (4 = 2 + 2) and linear.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators.graph import connected_components
from ..session import cut_lineage
from .common import words_of_text

MAX_BITS = 4
SHINGLE = 4
BLOCKS = 7
BUCKET = 1024
PIVOTS = 16


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_bits(blocks: int = BLOCKS) -> list[list[int]]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: XXH64 of small numbers, so that they are far apart and repeat."""
    return [xxhash.xxh64_intdigest(str(i), 7) for i in range(n)]


def fingerprint(text: str | None) -> int:
    """Bitwise majority over the XXH64 (seed 42) of the 4-word shingles, as a signed long; no words: 0."""
    words = words_of_text(text)
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[s:e], 42) for s, e in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist())]
    h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):  # bounded memory for very long texts
        counts += np.unpackbits(h[k:k + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint, na_action=None).astype("int64")


def _distance(x: Column, y) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def pivot_table(fp: Column, refs: list[int]) -> list[Column]:
    """Distances to the references, eight to a long (each below 128, so eight bits hold it)."""
    packs = []
    for k in range(0, len(refs), 8):
        pack = F.lit(0).cast("long")
        for j, p in enumerate(refs[k:k + 8]):
            pack = pack.bitwiseOR(F.shiftleft(_distance(fp, F.lit(_signed(p))).cast("long"), 8 * j))
        packs.append(pack)
    return packs


def _within(a: Column, b: Column, n: int) -> Column:
    """No coordinate of two packed tables differs by more than MAX_BITS."""
    at = lambda x, j: F.shiftright(x, 8 * j).bitwiseAND(127)
    ok = F.lit(True)
    for j in range(n):
        ok = ok & (F.abs(at(a, j) - at(b, j)) <= MAX_BITS)
    return ok


def near_links(fps: DataFrame, fp: str = "fp", blocks: int = BLOCKS, bucket: int = BUCKET, n_pivots: int = PIVOTS) -> DataFrame:
    """(u, v) of distinct fingerprints: all pairs within MAX_BITS, except inside block sets of more than ``bucket``
    fingerprints, where links suffice to connect all such pairs."""
    sets = list(combinations(range(blocks), blocks - MAX_BITS))
    bits = block_bits(blocks)
    masks = [_mask(b for i in s for b in bits[i]) for s in sets]
    refs = pivots(n_pivots)
    x = F.col("x")
    table = fps.where(F.col(fp).isNotNull()).select(F.col(fp).alias("x")).distinct()
    table = table.select("x", *[p.alias(f"p{i}") for i, p in enumerate(pivot_table(x, refs))])
    packs = [c for c in table.columns if c != "x"]
    keyed = table.select("x", *packs, F.posexplode(F.array(*[x.bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("s", "key"))
    big = cut_lineage(keyed.groupBy("s", "key").count().where(F.col("count") > bucket).select("s", "key"))
    big_sets = F.broadcast(big) if big.count() < 10_000 else big  # measured: a row is 12 bytes
    small = keyed.join(big_sets, ["s", "key"], "left_anti")
    # a fingerprint becomes a row per block set, which the optimizer's estimates don't know: these joins never broadcast
    a, b = small.alias("a"), small.alias("b").hint("merge")
    diff = F.col("a.x").bitwiseXOR(F.col("b.x"))
    near = F.lit(True)
    for i, c in enumerate(packs):
        near = near & _within(F.col(f"a.{c}"), F.col(f"b.{c}"), min(8, n_pivots - 8 * i))
    near = near & (F.bit_count(diff) <= MAX_BITS)
    links = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.x") < F.col("b.x")) & near)
    # the first set on which a pair agrees: its lowest agreeing blocks
    agree = [F.when(diff.bitwiseAND(F.lit(_signed(_mask(bb)))) == 0, F.lit(i)) for i, bb in enumerate(bits)]
    lowest = F.slice(F.array_compact(F.array(*agree)), 1, blocks - MAX_BITS)
    first = lowest == F.element_at(F.array(*[F.array(*[F.lit(i) for i in s]) for s in sets]), F.col("a.s") + 1)
    links = links.where(first).select(F.col("a.x").alias("u"), F.col("b.x").alias("v"))
    return links.unionByName(_meeting_links(keyed.join(big_sets, ["s", "key"], "left_semi"), masks))


def _meeting_links(keyed: DataFrame, masks: list[int]) -> DataFrame:
    """Members of large block sets that share a fingerprint within two flips are linked to the least of them."""
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    flips = [[0, *(1 << b for b in f), *((1 << b) | (1 << c) for b, c in combinations(f, 2))] for f in free]

    def meet(frames):
        for f in frames:
            for s, g in f.groupby("s"):
                flip = np.array(flips[int(s)], np.uint64)
                xs = g["x"].to_numpy(np.int64)
                for k in range(0, len(xs), 256):
                    part = xs[k:k + 256]
                    z = (part.view(np.uint64)[:, None] ^ flip[None, :]).view(np.int64)
                    yield pd.DataFrame({"s": np.int32(s), "z": z.ravel(), "x": np.repeat(part, len(flip))})

    met = keyed.select("s", "x").mapInPandas(meet, "s int, z long, x long")
    least = met.groupBy("s", "z").agg(F.min("x").alias("u"), F.max("x").alias("w")).where("u < w").select("s", "z", "u")
    return met.hint("merge").join(least, ["s", "z"]).where("u < x").select("u", F.col("x").alias("v")).distinct()


def _classes(rows: DataFrame, **kw) -> DataFrame:
    """(fp, c): the component of each fingerprint of ``rows``, named by one of its fingerprints."""
    classes = rows.select("fp").distinct()
    cc = connected_components(near_links(classes, **kw)).withColumnsRenamed({"node": "fp", "component": "c"})
    return classes.join(cc, "fp", "left").withColumn("c", F.coalesce("c", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """(doc_id, fp, component_id) for every row; the component is the smallest id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows are returned as often as they come; null ids
    never become a component's name (a component of null ids only has a null one).
    """
    rows = cut_lineage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_udf(F.col(f"`{text}`")).alias("fp")))
    named = _classes(rows, **kw).join(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp")
    names = named.groupBy("c").agg(F.min("first_id").alias("component_id"))
    labels = named.select("fp", "c").join(names, "c").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def dedup_stage(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """One document of each component stays, with its columns: the one with the smallest id, then with the smallest digest of its text;
    one row of it if it is repeated. A row without an id stays only in a component without ids."""
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    digest = F.md5(F.coalesce(F.col(at[text]), F.lit("")))
    rows = cut_lineage(named.select(F.col(at[id_col]).alias("doc_id"), digest.alias("key"), fingerprint_udf(F.col(at[text])).alias("fp")))
    firsts = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("r"))
    keep = _classes(rows, **kw).join(firsts, "fp").groupBy("c").agg(F.min("r").alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.key").alias("_key"))
    same = (digest == F.col("_key")) & F.col(at[id_col]).eqNullSafe(F.col("_id"))
    left = named.join(keep, same, "left_semi").withColumn("_k", digest).dropDuplicates([at[id_col], "_k"])
    return left.select(*[F.col(v).alias(c) for c, v in at.items()])
