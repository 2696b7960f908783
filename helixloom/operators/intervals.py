"""Interval algebra: overlap joins, merging, coverage, nearest neighbour.

Intervals are half-open ``[start, stop)``. Three rules keep every operator scalable:

* joins are equi-joins on (contig, level, bin). An interval owns the level whose bin width
  is at least its length (so it covers two bins at most) and each pair meets at the coarser
  of the two levels, in exactly one bin, so no ``distinct`` is needed afterwards;
* ordered scans (merging, nearest) run per genome tile over *distinct* positions, and only
  one summary row per tile is scanned per contig, so no task ever holds a whole contig and
  any number of copies of one position is collapsed by map-side aggregation first;
* no side is broadcast by hint: Catalyst and AQE do that when the measured size allows;
* numbers of overlaps and overlapping bases need no pairs: they are differences of running
  totals over distinct positions (``overlap_totals``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import reciprocal_ok, tile_of
from ..session import settle

#: bin widths of the three length classes; the last one also takes anything longer
LEVEL_WIDTHS = (1 << 15, 1 << 20, 1 << 25)
TILE = 1 << 20


def _level(length: Column, widths) -> Column:
    lev = F.lit(len(widths) - 1)
    for i in range(len(widths) - 2, -1, -1):
        lev = F.when(length <= widths[i], F.lit(i)).otherwise(lev)
    return lev


def _keyed(df, start, stop, widths, owner_first: bool):
    """Explode an interval into its join keys.

    ``mode`` 0 = the left interval owns the level, 1 = the right one does and is strictly
    longer. ``owner_first`` is True for the left side.
    """
    last = F.greatest(F.col(stop) - 1, F.col(start))
    own = _level(F.greatest(F.col(stop) - F.col(start), F.lit(0)), widths)
    keys = []
    for k, w in enumerate(widths):
        lo, hi = F.floor(F.col(start) / w).cast("long"), F.floor(last / w).cast("long")
        owned = F.transform(F.sequence(lo, hi), lambda b: F.struct(F.lit(k).alias("lev"), F.lit(0 if owner_first else 1).alias("mode"), b.alias("bin")))
        guest = F.transform(F.sequence(lo, hi), lambda b: F.struct(F.lit(k).alias("lev"), F.lit(1 if owner_first else 0).alias("mode"), b.alias("bin")))
        empty = F.filter(owned, lambda x: F.lit(False))
        if owner_first:  # left: mode 0 at its own level, mode 1 at strictly coarser levels
            keys += [F.when(own == k, owned).otherwise(empty), F.when(own < k, guest).otherwise(empty)]
        else:  # right: mode 0 at its own and coarser levels, mode 1 at its own level only
            keys += [F.when(own <= k, guest).otherwise(empty), F.when(own == k, owned).otherwise(empty)]
    return df.withColumn("_k", F.explode(F.concat(*keys))).select("*", "_k.lev", "_k.mode", "_k.bin").drop("_k")


def _hashed(df, by, parts):
    """One long join key over all key columns: cheap to shuffle and to sort. The columns
    themselves are compared again in the residual, so a hash collision cannot join rows."""
    return df.withColumn("_h", F.xxhash64(*by, *parts))


def _really_equal(x: str, y: str) -> Column:
    """Equality as a residual predicate (two inequalities do not become join keys)."""
    return (F.col(x) <= F.col(y)) & (F.col(x) >= F.col(y))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str] = ["chrom"],
    pad: int = 0,
    condition: Column | None = None,
    widths=LEVEL_WIDTHS,
    suffixes=("_a", "_b"),
    start="start",
    stop="stop",
    totals: bool = False,
) -> DataFrame:
    """All pairs of overlapping intervals. Columns of each side get that side's suffix.

    ``pad`` widens the left interval on both sides. ``condition`` is a residual predicate
    over the suffixed columns. A hot bin is split at run time by the AQE skew join. With
    ``totals`` the partners of a left row are not listed: the row comes once, with their
    number ``n`` and the sum of their overlaps ``bases``, both with the right side's suffix.
    """
    sa, sb = suffixes
    if totals:
        if pad or condition is not None:
            raise ValueError("totals are of plain overlaps, without padding or condition")
        d = overlap_totals(left, right, by, start, stop, "n" + sb, "bases" + sb)
        return d.where(F.col("n" + sb) > 0).withColumnsRenamed({c: c + sa for c in left.columns})
    a = left.select([F.col(c).alias(c + sa) for c in left.columns])
    b = right.select([F.col(c).alias(c + sb) for c in right.columns])
    a = a.withColumn("_s", F.col(start + sa) - pad).withColumn("_e", F.col(stop + sa) + pad)
    b = b.withColumn("_s", F.col(start + sb)).withColumn("_e", F.col(stop + sb))
    a = _hashed(_keyed(a, "_s", "_e", widths, True), [c + sa for c in by], ["lev", "mode", "bin"]).alias("l")
    b = _hashed(_keyed(b, "_s", "_e", widths, False), [c + sb for c in by], ["lev", "mode", "bin"]).alias("r")
    b = b.hint("merge")  # the optimizer's estimates don't know about the exploded keys: neither side is broadcast
    cond = [F.col("l._h") == F.col("r._h")] + [_really_equal(f"l.{c}", f"r.{c}") for c in ("lev", "mode", "bin")]
    cond += [_really_equal(c + sa, c + sb) for c in by]
    cond += [F.col("l._s") < F.col("r._e"), F.col("r._s") < F.col("l._e")]
    width = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("l.lev") + 1)
    cond += [F.col("l.bin") == F.floor(F.greatest(F.col("l._s"), F.col("r._s")) / width).cast("long")]
    if condition is not None:
        cond.append(condition)
    out = a.join(b, cond, "inner")
    keep = [c + sa for c in left.columns] + [c + sb for c in right.columns]
    return out.select(*keep)


def overlap_semi(left, right, key: list[str], anti: bool = False, by=["chrom"], pad: int = 0, merge_right: bool = True, **kw) -> DataFrame:
    """Rows of ``left`` that overlap (or do not overlap) anything in ``right``.

    The right side is reduced to its union first, so a pile of copies in ``right`` costs
    one row, and ``key`` (unique in ``left``) removes the double match of wide intervals.
    """
    if merge_right and kw.get("condition") is None:
        right = merge_intervals(right, by=by)
    hits = overlap_join(left, right, by=by, pad=pad, **kw).select(*[F.col(k + "_a").alias(k) for k in key]).distinct()
    return left.join(hits, key, "left_anti" if anti else "left_semi")


def overlap_left_join(left, right, key: list[str], **kw) -> DataFrame:
    """Left outer form: unmatched left rows appear once with nulls on the right; with ``totals`` every left row appears once, unmatched
    ones with zeros."""
    sa, sb = kw.get("suffixes", ("_a", "_b"))
    if kw.get("totals"):
        if set(kw) - {"by", "suffixes", "start", "stop", "totals"}:
            raise ValueError("totals are of plain overlaps, without padding or condition")
        d = overlap_totals(left, right, kw.get("by", ["chrom"]), kw.get("start", "start"), kw.get("stop", "stop"), "n" + sb, "bases" + sb)
        return d.withColumnsRenamed({c: c + sa for c in left.columns})
    pairs = overlap_join(left, right, **kw)
    rest = left.select([F.col(c).alias(c + sa) for c in left.columns]).join(
        pairs.select(*[k + sa for k in key]).distinct(), [k + sa for k in key], "left_anti"
    )
    return pairs.unionByName(rest, allowMissingColumns=True)


def _totals_at(points: DataFrame, rows: DataFrame, by: list[str], start: str, stop: str, tile: int = 1 << 16) -> DataFrame:
    """For each position _x of ``points`` and ``rows``: _before (rows that start before it), _ended (rows that end at or before it),
    _empty (empty rows on it) and _cov (bases of all rows before it). Running totals per tile; tiles exchange one row each."""
    x, zero, one = F.col("_x"), F.lit(0).cast("long"), F.lit(1).cast("long")
    empty = (F.col(start) == F.col(stop)).cast("long")
    ends = rows.select(*by, F.inline(F.array(
        F.struct(F.col(start).cast("long").alias("_x"), one.alias("_s"), zero.alias("_e"), empty.alias("_empty")),
        F.struct(F.col(stop).cast("long").alias("_x"), zero.alias("_s"), one.alias("_e"), zero.alias("_empty")))))
    u = points.select(*by, x.cast("long").alias("_x"), zero.alias("_s"), zero.alias("_e"), zero.alias("_empty")).unionByName(ends)
    u = u.groupBy(*by, "_x").agg(*[F.sum(c).alias(c) for c in ("_s", "_e", "_empty")])
    u = u.withColumn("_t", tile_of("_x", tile)).withColumn("_o", x * (F.col("_s") - F.col("_e")))
    w_by = Window.partitionBy(*by).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    w_tile = Window.partitionBy(*by, "_t").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    carry = u.groupBy(*by, "_t").agg(*[F.sum(c).alias("_c" + c) for c in ("_s", "_e", "_o")])
    carry = carry.select(*by, "_t", *[F.coalesce(F.sum("_c" + c).over(w_by), zero).alias("_c" + c) for c in ("_s", "_e", "_o")])
    u = u.join(carry, [*by, "_t"])
    s, e, o = (F.col("_c" + c) + F.sum(c).over(w_tile) for c in ("_s", "_e", "_o"))
    return u.select(*by, "_x", (s - F.col("_s")).alias("_before"), e.alias("_ended"), "_empty", (x * (s - e) - o).alias("_cov"))


def overlap_totals(left: DataFrame, right: DataFrame, by=["chrom"], start="start", stop="stop", n="n_over", bases="bases") -> DataFrame:
    """``left`` plus the number of overlapping rows of ``right`` and the sum of their overlaps, without forming a pair.

    Rows that start before the interval's end, less those that end by its start; bases likewise. Work grows with the rows, however
    many pairs they would make. Intervals that end before they start have no such difference, so those alone are joined.
    """
    known = F.lit(True)
    for c in (*by, start, stop):
        known = known & F.col(c).isNotNull()
    turned = F.col(start) > F.col(stop)
    a, b = left.where(known), right.where(known).select(*by, start, stop)
    ends = a.where(~turned).select(*by, F.explode(F.array(start, stop)).alias("_x"))
    at = settle(_totals_at(ends, b.where(~turned), by, start, stop))  # read at both ends
    first = at.select(*by, F.col("_x").alias(start), "_ended", "_empty", F.col("_cov").alias("_c0"))
    last = at.select(*by, F.col("_x").alias(stop), "_before", F.col("_cov").alias("_c1"))
    zero = F.lit(0).cast("long")
    d = left.join(first, [*by, start], "left").join(last, [*by, stop], "left")
    plain = F.when(~turned, F.col("_before") - F.col("_ended") + F.when(F.col(start) == F.col(stop), F.col("_empty")).otherwise(zero))
    d = d.withColumn(n, F.coalesce(plain, zero)).withColumn(bases, F.coalesce(F.when(~turned, F.col("_c1") - F.col("_c0")), zero))
    geo, odd = a.select(*by, start, stop), None
    for few, x, y in ((geo, geo.where(turned), b), (b, geo.where(~turned), b.where(turned))):
        if not few.where(turned).isEmpty():
            p = overlap_join(x.distinct(), y, by=by, start=start, stop=stop)
            odd = p if odd is None else odd.unionByName(p)
    if odd is not None:
        ov = F.least(F.col(stop + "_a"), F.col(stop + "_b")) - F.greatest(F.col(start + "_a"), F.col(start + "_b"))
        odd = odd.groupBy(*[F.col(c + "_a").alias(c) for c in (*by, start, stop)]).agg(F.count("*").alias("_n"), F.sum(ov).alias("_v"))
        d = d.join(odd, [*by, start, stop], "left").withColumn(n, F.col(n) + F.coalesce("_n", zero)).withColumn(bases, F.col(bases) + F.coalesce("_v", zero))
    return d.select(*left.columns, n, bases)


def reciprocal_join(left, right, frac: float, by=["chrom", "svtype"], condition=None, suffixes=("_a", "_b"), start="start", stop="stop", how: str = "inner") -> DataFrame:
    """Pairs whose overlap covers at least ``frac`` of both intervals (frac > 0).

    Such pairs have lengths within a factor 1/frac and starts within (1-frac) of the longer
    length, so the key is (length class, start bin) instead of the covered bins: far fewer
    candidates than an overlap join and no growth with interval length. A left interval has one
    key, so ``how="left_semi"`` gives its row once and stops at its first partner.
    """
    if not 0 < frac <= 1:
        raise ValueError("frac must be in (0, 1]; use overlap_join for any overlap")
    sa, sb = suffixes
    f = min(frac, 0.95)  # above it the classes would be needlessly narrow
    base = (1.0 / f) * (1 + 1e-9)
    slack = 1.0 - f

    def prep(df, sfx):
        d = df.select([F.col(c).alias(c + sfx) for c in df.columns])
        d = d.where(F.col(stop + sfx) > F.col(start + sfx))
        length = (F.col(stop + sfx) - F.col(start + sfx)).cast("double")
        return d.withColumn("_cls", F.floor(F.log(length) / F.log(F.lit(base))).cast("int"))

    def width(k):  # twice the largest start distance of partners of a left interval in class k
        reach = F.least(2 * slack * F.pow(F.lit(base), k + 2), F.lit(float(1 << 40)))  # no contig is longer
        return F.greatest(F.ceil(reach).cast("long"), F.lit(2).cast("long")) + 2

    a, b = prep(left, sa), prep(right, sb)
    a = a.withColumn("_bin", F.floor(F.col(start + sa) / width(F.col("_cls"))).cast("long"))
    # the right side visits the classes next to its own, in the one or two bins within reach
    b = b.withColumn("_cls", F.explode(F.array(F.col("_cls") - 1, F.col("_cls"), F.col("_cls") + 1))).withColumn("_w", width(F.col("_cls")))
    half = F.ceil(F.col("_w") / 2).cast("long")
    lo = F.floor((F.col(start + sb) - half) / F.col("_w")).cast("long")
    hi = F.floor((F.col(start + sb) + half) / F.col("_w")).cast("long")
    b = b.withColumn("_bin", F.explode(F.sequence(lo, hi))).drop("_w")
    a, b = _hashed(a, [c + sa for c in by], ["_cls", "_bin"]).alias("l"), _hashed(b, [c + sb for c in by], ["_cls", "_bin"]).alias("r")
    # the exploded side's size is not what the optimizer estimates, so it is never broadcast
    b = b.hint("merge")
    cond = [F.col("l._h") == F.col("r._h"), _really_equal("l._bin", "r._bin"), _really_equal("l._cls", "r._cls")]
    cond += [_really_equal(c + sa, c + sb) for c in by]
    cond.append(reciprocal_ok(F.col(start + sa), F.col(stop + sa), F.col(start + sb), F.col(stop + sb), frac))
    if condition is not None:
        cond.append(condition)
    kept = [c + sa for c in left.columns] + ([] if how == "left_semi" else [c + sb for c in right.columns])
    return a.join(b, cond, how).select(*kept)


def _tile_scan(distinct: DataFrame, by: list[str], start: str, stop: str, max_gap: int, tile: int) -> DataFrame:
    """Island start per distinct start position (see the module docstring)."""
    d = distinct.withColumn("_t", tile_of(start, tile))
    w_chrom = Window.partitionBy(*by).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    w_tile = Window.partitionBy(*by, "_t").orderBy(start)
    before = w_tile.rowsBetween(Window.unboundedPreceding, -1)
    carry = d.groupBy(*by, "_t").agg(F.max(stop).alias("_m")).select(*by, "_t", F.max("_m").over(w_chrom).alias("_in"))
    d = d.join(carry, [*by, "_t"])
    reach = F.greatest(F.col("_in"), F.max(stop).over(before))
    d = d.withColumn("_reach", reach)
    d = d.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + max_gap), F.col(start)))
    heads = d.groupBy(*by, "_t").agg(F.max("_new").alias("_h")).select(*by, "_t", F.max("_h").over(w_chrom).alias("_hin"))
    d = d.join(heads, [*by, "_t"])
    local = F.max("_new").over(w_tile.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("island", F.coalesce(local, F.col("_hin"))).drop("_t", "_in", "_reach", "_new", "_hin")


def merge_intervals(df, by=["chrom"], start="start", stop="stop", max_gap: int = 0, aggs: list[Column] | None = None, tile: int = TILE) -> DataFrame:
    """Union of intervals; touching ones and gaps up to ``max_gap`` are merged.

    ``aggs`` are extra aggregates over the member rows (needs one more join to map rows to
    their island; the plain form never touches the rows again).
    """
    d = df.groupBy(*by, start).agg(F.max(stop).alias(stop))
    isl = _tile_scan(d, by, start, stop, max_gap, tile)
    if not aggs:
        return isl.groupBy(*by, "island").agg(F.max(stop).alias(stop)).select(*by, F.col("island").alias(start), stop)
    rows = df.join(isl.select(*by, start, "island"), [*by, start])
    return rows.groupBy(*by, "island").agg(F.max(stop).alias("_stop"), *aggs).withColumnsRenamed({"island": start, "_stop": stop})


def assign_islands(df, by=["chrom"], start="start", stop="stop", max_gap: int = 0, tile: int = TILE, name: str = "island") -> DataFrame:
    """Label every row with the start of its merged island."""
    d = df.groupBy(*by, start).agg(F.max(stop).alias(stop))
    isl = _tile_scan(d, by, start, stop, max_gap, tile).select(*by, start, F.col("island").alias(name))
    return df.join(isl, [*by, start])


def covered_bases(left, right, key: list[str], by=["chrom"], start="start", stop="stop") -> DataFrame:
    """``left`` plus ``covered``: bases of each interval inside the union of ``right``."""
    u = merge_intervals(right, by=by, start=start, stop=stop)
    cols = list(dict.fromkeys([*by, *key, start, stop]))
    p = overlap_join(left.select(*cols), u, by=by, start=start, stop=stop)
    ov = F.least(F.col(stop + "_a"), F.col(stop + "_b")) - F.greatest(F.col(start + "_a"), F.col(start + "_b"))
    s = p.groupBy(*[F.col(k + "_a").alias(k) for k in key]).agg(F.sum(ov).alias("covered"))
    return left.join(s, key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))


def coverage_fraction(left, right, key, by=["chrom"], start="start", stop="stop") -> DataFrame:
    length = F.col(stop) - F.col(start)
    return covered_bases(left, right, key, by, start, stop).withColumn(
        "coverage", F.when(length > 0, F.col("covered") / length).otherwise(F.lit(0.0))
    )


def point_in_regions(points, regions, pos: str, chrom: str = "chrom", anti: bool = False, width: int = 1 << 15) -> DataFrame:
    """Keep points inside (or outside) the regions. A point has one bin, so this is one semi join."""
    u = merge_intervals(regions)
    u = u.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    u = u.withColumn("_b", F.explode(F.sequence(tile_of("_s", width), tile_of(F.col("_e") - 1, width))))
    p = points.withColumn("_pb", tile_of(pos, width))
    cond = (F.col(chrom) == F.col("_c")) & (F.col("_pb") == F.col("_b")) & (F.col(pos) >= F.col("_s")) & (F.col(pos) < F.col("_e"))
    return p.join(u, cond, "left_anti" if anti else "left_semi").drop("_pb")


def window_join(left, right, by: list[tuple[str, str]], pos: tuple[str, str], before: int, after: int, condition=None) -> DataFrame:
    """Pairs with right.pos in [left.pos - before, left.pos + after]; column names must differ.

    One bin on the left, the few bins the window touches on the right.
    """
    w = max(before + after, 1)
    a = left.withColumn("_wb", F.explode(F.sequence(tile_of(F.col(pos[0]) - before, w), tile_of(F.col(pos[0]) + after, w))))
    b = right.withColumn("_rb", tile_of(pos[1], w))
    cond = [F.col("_wb") == F.col("_rb"), F.col(pos[1]).between(F.col(pos[0]) - before, F.col(pos[0]) + after)]
    cond += [F.col(x) == F.col(y) for x, y in by]
    if condition is not None:
        cond.append(condition)
    return a.hint("merge").join(b, cond).drop("_wb", "_rb")  # the exploded side is larger than its estimate


def neighbours(points, refs, by=["chrom"], pos="pos", tile: int = TILE) -> DataFrame:
    """For each distinct point: the closest reference position at or before and at or after it.

    Returns by + pos + prev_pos + next_pos. Both sides are reduced to distinct positions, so
    a tile holds at most ``tile`` rows whatever the input size; tiles exchange one row each.
    """
    p = points.select(*by, pos).distinct().withColumn("_ref", F.lit(False))
    r = refs.select(*by, pos).distinct().withColumn("_ref", F.lit(True))
    u = p.unionByName(r).groupBy(*by, pos).agg(F.bool_or("_ref").alias("_ref"), F.bool_or(~F.col("_ref")).alias("_pt"))
    u = u.withColumn("_t", tile_of(pos, tile)).withColumn("_rp", F.when(F.col("_ref"), F.col(pos)))
    w_lo = Window.partitionBy(*by).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    w_hi = Window.partitionBy(*by).orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, -1)
    t = u.groupBy(*by, "_t").agg(F.min("_rp").alias("_mn"), F.max("_rp").alias("_mx"))
    t = t.select(*by, "_t", F.max("_mx").over(w_lo).alias("_lo"), F.min("_mn").over(w_hi).alias("_hi"))
    # both frames grow from their first row: one that shrinks towards the last would be summed up anew for every row
    up, down = (Window.partitionBy(*by, "_t").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(pos), F.desc(pos)))
    u = u.join(t, [*by, "_t"])
    prev = F.coalesce(F.max("_rp").over(up), F.col("_lo"))
    nxt = F.coalesce(F.min("_rp").over(down), F.col("_hi"))
    u = u.withColumn("prev_pos", prev).withColumn("next_pos", nxt)
    return u.where("_pt").select(*by, pos, "prev_pos", "next_pos")
