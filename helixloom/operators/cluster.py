"""Single-linkage clustering of breakpoints and calls, and merging of the clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import is_carrier, joined, reciprocal_ok, tile_of
from ..session import cut_lineage, settle
from .graph import connected_components, label_components
from .intervals import assign_islands, reciprocal_join


def _cell_id(*cols) -> Column:
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def slink(df: DataFrame, dist: int, key: str = "name", by: list[str] = [], chr_a="chr_a", pos_a="pos_a", chr_b="chr_b", pos_b="pos_b", name="cluster") -> DataFrame:
    """Single linkage with both ends strictly within ``dist``; adds the cluster's base id.

    Work is linear in the input whatever its density: points of one dist x dist cell are
    always linked, so the graph is built on *cells*. Side neighbours are decided by the
    cells' extremes, diagonal ones by their Pareto frontiers (at most ``dist`` points each).
    """
    g = [*by, chr_a, chr_b]
    pts = df.withColumn("_ca", tile_of(pos_a, dist)).withColumn("_cb", tile_of(pos_b, dist))
    cell = [*g, "_ca", "_cb"]
    uniq = pts.groupBy(*cell, pos_a).agg(F.min(pos_b).alias("_lo"), F.max(pos_b).alias("_hi"))
    box = uniq.groupBy(*cell).agg(F.min(pos_a).alias("_a0"), F.max(pos_a).alias("_a1"), F.min("_lo").alias("_b0"), F.max("_hi").alias("_b1"))
    ident = _cell_id(*[F.col(c) for c in cell])

    def shifted(d, da, db, keep):
        """The upper neighbour, keyed by the cell it neighbours."""
        return d.select(*g, (F.col("_ca") - da).alias("_ca"), (F.col("_cb") - db).alias("_cb"), ident.alias("_nid"), *[F.col(c).alias("_n" + c) for c in keep])

    base = box.withColumn("_id", ident)
    side_a = base.join(shifted(box, 1, 0, ["_a0"]), cell).where(F.col("_n_a0") - F.col("_a1") < dist)
    side_b = base.join(shifted(box, 0, 1, ["_b0"]), cell).where(F.col("_n_b0") - F.col("_b1") < dist)

    def frontier(value, order, better):
        w = Window.partitionBy(*cell).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        best = (F.max(value) if better > 0 else F.min(value)).over(w)
        ok = best.isNull() | (F.col(value) > best if better > 0 else F.col(value) < best)
        return uniq.withColumn("_ok", ok).where("_ok").select(*cell, F.col(pos_a).alias("_x"), F.col(value).alias("_y"))

    # (+1, +1): upper-right frontier below, lower-left frontier above
    ne = frontier("_hi", F.desc(pos_a), 1).withColumn("_id", ident).join(shifted(frontier("_lo", F.asc(pos_a), -1), 1, 1, ["_x", "_y"]), cell)
    ne = ne.where((F.col("_n_x") - F.col("_x") < dist) & (F.col("_n_y") - F.col("_y") < dist))
    # (+1, -1): lower-right frontier on the left, upper-left frontier on the right
    se = frontier("_lo", F.desc(pos_a), -1).withColumn("_id", ident).join(shifted(frontier("_hi", F.asc(pos_a), 1), 1, -1, ["_x", "_y"]), cell)
    se = se.where((F.col("_n_x") - F.col("_x") < dist) & (F.col("_y") - F.col("_n_y") < dist))
    edges = None
    for e in (side_a, side_b, ne, se):
        e = e.select(F.col("_id").alias("u"), F.col("_nid").alias("v"))
        edges = e if edges is None else edges.unionByName(e)
    pts = pts.withColumn("_cell", ident)
    cc = connected_components(edges.distinct()).withColumnsRenamed({"node": "_cell", "component": "_cc"})
    lab = pts.join(cc, "_cell", "left").withColumn("_cc", F.coalesce("_cc", "_cell")).drop("_cell", "_ca", "_cb")
    return name_clusters(lab, "_cc", pos_a, key, name)


def name_clusters(df: DataFrame, comp: str, pos: str, key: str, name: str = "cluster") -> DataFrame:
    """Replace a component label by the id of its base record: smallest (position, id)."""
    base = df.groupBy(comp).agg(F.min_by(key, F.struct(F.col(pos), F.col(key))).alias(name))
    return df.join(base, comp).drop(comp)


def slink_single_end(df, dist: int, key="name", chr_a="chr_a", pos_a="pos_a", chr_b="chr_b", pos_b="pos_b", name="cluster") -> DataFrame:
    """Either end within ``dist``, inside one candidate batch (first ends chained by gaps < dist).

    One-dimensional single linkage is gap chaining, so both ends become islands and the
    graph only links island to island.
    """
    d = candidate_batches(df, dist, chr_a, pos_a, "_batch")
    g = [chr_a, "_batch", chr_b]
    d = assign_islands(d.withColumn("_e", F.col(pos_a) + dist - 1), by=g, start=pos_a, stop="_e", name="_ia")
    d = assign_islands(d.withColumn("_e", F.col(pos_b) + dist - 1), by=g, start=pos_b, stop="_e", name="_ib").drop("_e")
    gid = [F.col(c) for c in g]
    d = d.withColumn("_u", _cell_id(F.lit("a"), *gid, F.col("_ia"))).withColumn("_v", _cell_id(F.lit("b"), *gid, F.col("_ib")))
    d = cut_lineage(d)  # read by the graph and by the final join
    cc = connected_components(d.select("_u", "_v").distinct(), "_u", "_v").withColumnsRenamed({"node": "_u", "component": "_cc"})
    d = d.join(cc, "_u").drop("_u", "_v", "_ia", "_ib", "_batch")
    return name_clusters(d, "_cc", pos_a, key, name)


def candidate_batches(df, dist: int, chr_a="chr_a", pos_a="pos_a", name="batch") -> DataFrame:
    """Batch start per row: a batch ends where the next first end is ``dist`` or more away."""
    return assign_islands(df.withColumn("_e", F.col(pos_a) + dist - 1), by=[chr_a], start=pos_a, stop="_e", name=name).drop("_e")


def carrier_lists(carriers: DataFrame, vid="vid", sample="sample") -> DataFrame:
    """(_v, _n, _l): number of distinct carriers of each variant and their numbers in the order of the cohort's samples."""
    c = carriers.select(F.col(vid).alias("_v"), F.col(sample).alias("_s")).distinct()
    ids = c.select("_s").distinct().where("_s IS NOT NULL").select("_s", F.row_number().over(Window.orderBy("_s")).alias("_k"))  # one row per sample
    return c.join(ids, "_s", "left").groupBy("_v").agg(F.count("*").alias("_n"), F.sort_array(F.collect_set("_k")).alias("_l"))


def carrier_overlap(pairs: DataFrame, carriers: DataFrame, a="vid_a", b="vid_b", vid="vid", sample="sample") -> DataFrame:
    """Add n_a, n_b, n_both: carriers of each side and shared ones. A variant's carriers are one list of numbers, so a pair stays one row."""
    lists = carrier_lists(carriers, vid, sample)
    out = pairs
    for side, x in ((a, "a"), (b, "b")):
        out = out.join(lists.select(F.col("_v").alias(side), F.col("_n").alias(f"n_{x}"), F.col("_l").alias(f"_l{x}")), side, "left")
    zero = F.lit(0).cast("long")
    out = out.withColumn("n_both", shared_carriers("_la", "_lb")).drop("_la", "_lb")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("n_a", "n_b", "n_both")})


def shared_carriers(a: str, b: str) -> Column:
    """Number of carriers that two lists have in common."""
    return F.size(F.array_intersect(a, b)).cast("long")


def sharing_pairs(rows: DataFrame, carriers: DataFrame, share: float, key: str = "e") -> DataFrame:
    """(vid_a, vid_b, n_both): variants with a key of ``rows`` (vid, key) in common and at least ``share`` > 0 of the larger carrier set.

    Carriers are compared within the join, so pairs that share too few are never shuffled.
    """
    r = rows.distinct().join(carrier_lists(carriers).withColumnRenamed("_v", "vid"), "vid")
    x, y = (r.select(key, *[F.col(c).alias(f"{c}_{i}") for c in ("vid", "_n", "_l")]) for i in "ab")
    least, most, both = F.least("_n_a", "_n_b"), F.greatest("_n_a", "_n_b"), shared_carriers("_l_a", "_l_b")
    p = x.hint("merge").join(y, key).where((F.col("vid_a") < F.col("vid_b")) & (least >= share * most) & (both >= share * most))
    return p.select("vid_a", "vid_b", both.alias("n_both")).distinct()


def shares_samples(upper: float = 0.5, lower: float = 0.5) -> Column:
    """The larger shared fraction reaches ``upper`` and the smaller one ``lower``; empty sets share nothing."""
    fa, fb = F.col("n_both") / F.col("n_a"), F.col("n_both") / F.col("n_b")
    ok = (F.greatest(fa, fb) >= upper) & (F.least(fa, fb) >= lower)
    return F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), ok).otherwise(F.lit(lower <= 0 and upper <= 0))


def _cell_components(rep: DataFrame, by: list[str], dist: int, frac: float) -> DataFrame:
    """``rep`` with ``_cc``, the smallest vid of its component of linked sites.

    Cells are so small that all sites of one are linked. Cells whose boxes link any two of their sites make components first; sites are
    compared only between cells that may link and are in different components yet. So dense sites cost their cells, not their pairs.
    """
    size, ins = F.col("_end") - F.col("pos"), F.col("svtype") == "INS"
    anyway = F.col("_free") | F.lit(frac <= 0)
    sized = F.greatest(F.lit(1), F.least(F.lit(dist), F.floor((1 - frac) * F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1)))) - 1)) + 1))  # ends closer than this overlap enough
    whole = F.lit(dist > 0) & (anyway | (size > 0)) & (~ins | F.col("alt").isNotNull())
    for c in (*by, "pos", "stop", "_end", "_free"):
        whole = whole & F.col(c).isNotNull()
    half = max(dist // 2, 1)
    w = F.when(anyway, F.lit(half)).otherwise(F.greatest(F.floor(sized / 2), F.lit(1))).cast("long")
    r = rep.where("vid IS NOT NULL").withColumn("_whole", F.coalesce(whole, F.lit(False)))
    r = r.withColumns({"_w": F.when(F.col("_whole"), w), "_own": F.when(~F.col("_whole"), F.col("vid")), "_alt": F.when(ins, F.col("alt"))})
    key = [*by, "_alt", "_free", "_own", "_w", "_x", "_y", "_z"]
    r = r.withColumns({"_x": F.floor(F.col("pos") / F.col("_w")).cast("long"), "_y": F.floor(F.col("_end") / F.col("_w")).cast("long"), "_z": F.when(F.col("_whole"), tile_of("stop", half))})
    r = settle(r.withColumn("_cell", F.min("vid").over(Window.partitionBy(*key))))
    low, high = [F.min(c).alias(f"{c}_0") for c in ("pos", "stop", "_end")], [F.max(c).alias(f"{c}_1") for c in ("pos", "stop", "_end")]
    cells = settle(r.groupBy(*key, "_cell").agg(*low, *high).select(*by, "_alt", "_free", "_cell", *[f"{c}_{i}" for c in ("pos", "stop", "_end") for i in (0, 1)]))
    at = lambda c, side: F.col(f"{c}_{side}")
    is_free = F.coalesce(at("_free", "a"), F.lit(False)) | F.coalesce(at("_free", "b"), F.lit(False)) | F.lit(frac <= 0)
    generic = lambda side: at("_alt", side) == "<INS>"
    other = (F.col("svtype_a") != "INS") | (F.col("_alt_a") == F.col("_alt_b"))

    def widest(c):
        return F.greatest(at(f"{c}_1", "a"), at(f"{c}_1", "b")) - F.least(at(f"{c}_0", "a"), at(f"{c}_0", "b"))

    def gap(c):
        return F.greatest(at(f"{c}_0", "a"), at(f"{c}_0", "b")) - F.least(at(f"{c}_1", "a"), at(f"{c}_1", "b"))

    longest = F.greatest(*[at("_end_1", i) - at("pos_0", i) for i in "ab"])
    shortest = F.greatest(*[at("_end_0", i) - at("pos_1", i) for i in "ab"])
    least = F.least(*[at("_end_0", i) for i in "ab"]) - F.greatest(*[at("pos_1", i) for i in "ab"])
    most = F.least(*[at("_end_1", i) for i in "ab"]) - F.greatest(*[at("pos_0", i) for i in "ab"])
    ends = at("_end_0", "a").isNotNull() & at("_end_0", "b").isNotNull()  # least and greatest pass over nulls
    before = (generic("a") & (at("pos_1", "a") < at("pos_0", "b"))) | (generic("b") & (at("pos_1", "b") < at("pos_0", "a")))
    sure = (widest("pos") < dist) & (widest("stop") < dist) & (is_free | (ends & (least > 0) & (least >= frac * longest))) & (other | before)
    maybe = (gap("pos") < dist) & (gap("stop") < dist) & (is_free | (ends & (most > 0) & (most >= frac * shortest))) & (other | generic("a") | generic("b"))

    def near(d, cond):
        """Pairs of different cells within reach. A cell is at most half as wide as ``dist``, so starts are within one and a half."""
        reach, wide = dist + half, 2 * (dist + half)
        x, y = (d.select([F.col(c).alias(f"{c}_{i}") for c in d.columns]) for i in "ab")
        x = x.withColumns({"_p": tile_of("pos_0_a", wide), "_q": tile_of("stop_0_a", wide)})
        for c, k in (("pos_0_b", "_p"), ("stop_0_b", "_q")):
            y = y.withColumn(k, F.explode(F.sequence(tile_of(F.col(c) - reach, wide), tile_of(F.col(c) + reach, wide))))
        x, y = x.alias("l"), y.alias("r").hint("merge")
        meet = [F.col("l._p") == F.col("r._p"), F.col("l._q") == F.col("r._q"), *[F.col(c + "_a") == F.col(c + "_b") for c in by]]
        return x.join(y, [*meet, F.col("_cell_a") < F.col("_cell_b"), cond])

    def merged(edges, of, name):
        cc = connected_components(edges.distinct()).withColumnsRenamed({"node": of, "component": name})
        return lambda d: d.join(cc, of, "left").withColumn(name, F.coalesce(name, of))

    # a vid of several geometries is one node
    several = r.groupBy("vid").agg(F.min("_cell").alias("v"), F.max("_cell").alias("_m")).where("v <> _m").select("vid", "v")
    edges = near(cells, sure).select(F.col("_cell_a").alias("u"), F.col("_cell_b").alias("v")).unionByName(r.join(several, "vid").select(F.col("_cell").alias("u"), "v"))
    cells = settle(merged(edges, "_cell", "_c1")(cells))
    open_pairs = near(cells, maybe & (F.col("_c1_a") != F.col("_c1_b"))).select("_cell_a", "_cell_b", "_c1_a", "_c1_b").distinct()
    x, y = (r.select(*[F.col(c).alias(f"{c}_{i}") for c in ("_cell", "vid", *by, "alt", "pos", "stop", "_end", "_free")]) for i in "ab")
    first = (F.col("pos_a") < F.col("pos_b")) | ((F.col("pos_a") == F.col("pos_b")) & (F.col("vid_a") < F.col("vid_b")))
    then = (F.col("pos_b") < F.col("pos_a")) | ((F.col("pos_a") == F.col("pos_b")) & (F.col("vid_b") < F.col("vid_a")))
    subclass = (F.col("svtype_a") != "INS") | (F.col("alt_a") == F.col("alt_b")) | (first & (F.col("alt_a") == "<INS>")) | (then & (F.col("alt_b") == "<INS>"))
    ro = reciprocal_ok(F.col("pos_a"), F.col("_end_a"), F.col("pos_b"), F.col("_end_b"), frac)
    linked = (first | then) & subclass & (F.col("_free_a") | F.col("_free_b") | ro) & (F.abs(F.col("pos_a") - F.col("pos_b")) < dist) & (F.abs(F.col("stop_a") - F.col("stop_b")) < dist)
    for c in by:  # cells of one id may differ in them
        linked = linked & (F.col(c + "_a") == F.col(c + "_b"))
    late = open_pairs.join(x, "_cell_a").join(y, "_cell_b").where(linked).select(F.col("_c1_a").alias("u"), F.col("_c1_b").alias("v"))
    both = merged(late, "_c1", "_cc")(cells.select("_cell", "_c1").distinct())
    return r.join(both.select("_cell", "_cc"), "_cell").select(*rep.columns, "_cc")


def cluster_sites(
    sites: DataFrame,
    dist: int = 300,
    frac: float = 0.1,
    sample_overlap: float = 0.0,
    carriers: DataFrame | None = None,
    match_strands: bool = True,
    name="cluster",
) -> DataFrame:
    """Cluster variant sites: type, strands, both ends within ``dist``, reciprocal overlap, shared carriers.

    Sites need vid, chrom, chr2, pos, stop, svtype, strands, svlen, alt. Overlap is always
    met across contigs and for insertions of unknown length; other insertions use pos + svlen.
    A specific insertion subclass blocks a link only when it is the upstream record. Without
    a sample condition, identical geometries are collapsed first, so copies cost one node, and
    linkage runs over cells of geometries (``_cell_components``) instead of pairs.
    """
    geo = ["chrom", "chr2", "svtype", "strands", "alt", "pos", "stop", "svlen"]
    end = F.when(F.col("svtype") == "INS", F.col("pos") + F.col("svlen")).otherwise(F.col("stop"))
    free = (F.col("chrom") != F.col("chr2")) | ((F.col("svtype") == "INS") & (F.col("svlen") == -1))
    s = sites.select("vid", *geo).withColumn("_end", end).withColumn("_free", free)
    rep = s
    if sample_overlap <= 0:
        rep = s.groupBy(*geo, "_end", "_free").agg(F.min("vid").alias("vid"))
    by = ["chrom", "chr2", "svtype"] + (["strands"] if match_strands else [])
    if sample_overlap > 0:
        w = 2 * dist
        a = rep.select([F.col(c).alias(c + "_a") for c in rep.columns])
        b = rep.select([F.col(c).alias(c + "_b") for c in rep.columns])
        a = a.withColumn("_ca", tile_of("pos_a", w)).withColumn("_cb", tile_of("stop_a", w))
        b = b.withColumn("_ca", F.explode(F.sequence(tile_of(F.col("pos_b") - dist, w), tile_of(F.col("pos_b") + dist, w))))
        b = b.withColumn("_cb", F.explode(F.sequence(tile_of(F.col("stop_b") - dist, w), tile_of(F.col("stop_b") + dist, w))))
        a, b = a.alias("l"), b.alias("r")
        upstream = (F.col("pos_a") < F.col("pos_b")) | ((F.col("pos_a") == F.col("pos_b")) & (F.col("vid_a") < F.col("vid_b")))
        ro = reciprocal_ok(F.col("pos_a"), F.col("_end_a"), F.col("pos_b"), F.col("_end_b"), frac)
        exempt = (F.col("chrom_a") != F.col("chr2_a")) | F.col("_free_a") | F.col("_free_b")
        subclass = (F.col("svtype_a") != "INS") | (F.col("alt_a") == F.col("alt_b")) | (F.col("alt_a") == "<INS>")
        cond = [F.col("l._ca") == F.col("r._ca"), F.col("l._cb") == F.col("r._cb"), upstream, subclass, exempt | ro]
        cond += [F.col(c + "_a") == F.col(c + "_b") for c in by]
        cond += [F.abs(F.col("pos_a") - F.col("pos_b")) < dist, F.abs(F.col("stop_a") - F.col("stop_b")) < dist]
        pairs = a.join(b, cond).select("vid_a", "vid_b")
        pairs = carrier_overlap(pairs, carriers).where(shares_samples(sample_overlap, sample_overlap)).select("vid_a", "vid_b")
        lab = label_components(s, pairs, "vid", "vid_a", "vid_b", "_cc")
    else:
        lab = _cell_components(rep, by, dist, frac)
        # copies of one geometry are linked to each other unless they have no length to overlap
        selfok = F.col("_free") | (F.col("_end") > F.col("pos")) if frac > 0 else F.lit(True)
        keyed = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in geo]
        lab = s.alias("x").join(lab.select(*geo, F.col("_cc")).alias("y"), keyed).select("x.*", "y._cc")
        lab = lab.withColumn("_cc", F.when(selfok, F.col("_cc")).otherwise(F.col("vid")))
    named = name_clusters(lab.select("vid", "pos", "_cc"), "_cc", "pos", "vid", name)
    return sites.join(named.select("vid", name), "vid")


def merge_sites(labelled: DataFrame, cluster="cluster") -> DataFrame:
    """One site per cluster: median coordinates (truncated), base record's type and strands,
    sorted union of algorithms, member ids, coordinate ranges and spread."""
    order = F.struct("pos", "vid")
    base = lambda c: F.min_by(c, order)
    known = F.when(F.col("svlen") > -1, F.col("svlen"))
    alg = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("algorithms", ",")))))
    m = labelled.groupBy(cluster).agg(
        base("chrom").alias("chrom"), base("chr2").alias("chr2"), base("svtype").alias("svtype"), base("strands").alias("strands"),
        F.floor(F.percentile("pos", F.lit(0.5))).alias("pos"), F.floor(F.percentile("stop", F.lit(0.5))).alias("stop"),
        F.bround(F.percentile(known, F.lit(0.5)), 0).cast("long").alias("_ins_len"),
        F.array_join(alg, ",").alias("algorithms"), joined("vid").alias("members"), F.count("*").alias("n_members"),
        F.min("pos").alias("_p0"), F.max("pos").alias("_p1"), F.min("stop").alias("_e0"), F.max("stop").alias("_e1"),
        F.sqrt(F.var_pop("pos") + F.var_pop("stop")).alias("rmsstd"),
    )
    svlen = (
        F.when(F.col("chrom") != F.col("chr2"), F.lit(-1))
        .when(F.col("svtype") == "INS", F.coalesce("_ins_len", F.lit(-1)))
        .otherwise(F.col("stop") - F.col("pos"))
    )
    m = m.withColumn("svlen", svlen.cast("long"))
    for out, c, mid in (("cipos_lo", "_p0", "pos"), ("cipos_hi", "_p1", "pos"), ("ciend_lo", "_e0", "stop"), ("ciend_hi", "_e1", "stop")):
        m = m.withColumn(out, F.col(c) - F.col(mid))
    return m.drop("_ins_len", "_p0", "_p1", "_e0", "_e1")


def merge_carrier_genotypes(labelled, genotypes, cluster="cluster") -> DataFrame:
    """0/1 for a sample called in any member record, 0/0 otherwise."""
    g = genotypes.join(labelled.select("vid", cluster), "vid")
    return g.groupBy(cluster, "sample").agg(F.max(F.when(is_carrier(), 1).otherwise(0)).cast("int").alias("a2")).withColumn("a1", F.lit(0))


def best_genotypes(rows: DataFrame, by: list[str], fields: list[str], order: str = "vid") -> DataFrame:
    """Best genotype per key: non-reference first, then highest GQ, the later record on a tie."""
    rank = F.struct(is_carrier().cast("int"), F.coalesce("gq", F.lit(-1)), F.col(order))
    return rows.groupBy(*by).agg(*[F.max_by(f, rank).alias(f) for f in fields])


def reciprocal_components(rows: DataFrame, frac: float, key: str = "name", by: list[str] = ["chrom", "svtype"], name: str = "component") -> DataFrame:
    """``rows`` with the smallest ``key`` of its component of intervals that overlap by ``frac`` of both; pairs aren't listed.

    Intervals of one cell (length class, place of either end) all overlap enough, so cells are linked instead of intervals: neighbouring
    cells by one member each, then cells of different components by one member each, and members are compared only between cells that
    are in different components still and may hold a linked pair. Rows of one key are one node; intervals without length link nothing.
    """
    if not 0 < frac <= 1:
        raise ValueError("frac must be in (0, 1]")
    size, g, at = F.col("stop") - F.col("start"), frac / (2 - frac), [*by, "_k", "_x", "_y"]
    known = F.col("stop") > F.col("start")
    for c in (key, *by):
        known = known & F.col(c).isNotNull()
    known = F.coalesce(known, F.lit(False))
    r = rows.where(known).withColumn("_k", F.floor(F.log2(size.cast("double")) - 1e-9).cast("int"))
    w = F.floor((1 - frac) * F.pow(F.lit(2.0), F.col("_k") - 1) * (1 - 1e-9)).cast("long") + 1  # ends of a cell differ by half of what an overlap may lack
    r = r.withColumns({"_x": F.floor(F.col("start") / w).cast("long"), "_y": F.floor(F.col("stop") / w).cast("long")})
    geo = [F.col(c).cast("long").alias(c) for c in ("start", "stop")]
    cells = r.select(key, *at, *geo).groupBy(*at).agg(
        F.min(F.struct(key, "start", "stop")).alias("_r"), *[x(c).alias(c + n) for c in ("start", "stop") for x, n in ((F.min, "0"), (F.max, "1"))])
    cells = settle(cells.withColumn("_cell", F.monotonically_increasing_id()))
    rep = cells.select(*at, "_cell", "_r.start", "_r.stop")

    def merged(d, edges, old, new):
        cc = connected_components(edges.distinct()).withColumnsRenamed({"node": old, "component": new})
        return d.join(cc, old, "left").withColumn(new, F.coalesce(new, old))

    beside = F.array(*[F.struct((F.col("_x") + i).alias("_x"), (F.col("_y") + j).alias("_y")) for i, j in ((1, 0), (0, 1), (1, 1))])
    a = rep.select(*by, "_k", F.col("_cell").alias("u"), F.col("start").alias("_s"), F.col("stop").alias("_e"), F.inline(beside))
    edges = a.hint("merge").join(rep, at).where(reciprocal_ok(F.col("_s"), F.col("_e"), F.col("start"), F.col("stop"), frac)).select("u", F.col("_cell").alias("v"))
    # keys found in several cells, first by hash, so that keys are not shuffled
    h, cell = F.xxhash64(key).alias("_h"), F.xxhash64(*at).alias("_c")
    twice = settle(r.select(h, cell).groupBy("_h").agg(F.min("_c").alias("_a"), F.max("_c").alias("_z")).where("_a <> _z").select("_h"))
    again = r.select(key, *at, h).join(twice, "_h", "left_semi").join(cells.select(*at, "_cell"), at).select(key, "_cell").distinct()
    edges = edges.unionByName(again.select(F.min("_cell").over(Window.partitionBy(key)).alias("u"), F.col("_cell").alias("v")).where("u <> v"))
    cells = settle(merged(cells, edges, "_cell", "_c1"))
    rep = cells.select(*by, "_c1", "_r.start", "_r.stop")
    edges = reciprocal_join(rep, rep, frac, by=by, condition=F.col("_c1_a") < F.col("_c1_b")).select(F.col("_c1_a").alias("u"), F.col("_c1_b").alias("v"))
    cells = settle(merged(cells, edges, "_c1", "_c2"))
    # an interval is the shorter by half of what it may lack at most than the span of its cell, so spans of linked intervals overlap by ``g``
    box = cells.select(*by, "_cell", "_c2", F.col("start0").alias("start"), F.col("stop1").alias("stop"), "start1", "stop0")
    most = F.least("stop_a", "stop_b") - F.greatest("start_a", "start_b")
    maybe = most >= frac * F.greatest(F.col("stop0_a") - F.col("start1_a"), F.col("stop0_b") - F.col("start1_b"))
    near = reciprocal_join(box, box, g * (1 - 1e-9), by=by, condition=(F.col("_c2_a") < F.col("_c2_b")) & maybe)
    near = settle(near.select("_cell_a", "_cell_b", "_c2_a", "_c2_b").distinct())
    open_ = near.select(F.explode(F.array("_cell_a", "_cell_b")).alias("_cell")).distinct()
    m = settle(r.select(*at, *geo).join(cells.select(*at, "_cell").join(open_, "_cell", "left_semi"), at).select("_cell", "start", "stop").distinct())
    x, y = (m.select(*[F.col(c).alias(f"{c}_{i}") for c in m.columns]) for i in "ab")
    both = reciprocal_ok(F.col("start_a"), F.col("stop_a"), F.col("start_b"), F.col("stop_b"), frac)
    edges = near.hint("merge").join(x, "_cell_a").join(y, "_cell_b").where(both).select(F.col("_c2_a").alias("u"), F.col("_c2_b").alias("v"))
    label = merged(cells.select(*at, "_c2", F.col(f"_r.{key}").alias("_first")), edges, "_c2", "_c3")
    label = label.join(label.groupBy("_c3").agg(F.min("_first").alias(name)), "_c3").select(*at, name)
    out = r.join(label, at).select(*rows.columns, name)
    rest = rows.where(~known)
    if rest.isEmpty():
        return out
    named = out.select(key, name).join(rest.select(key), key, "left_semi").distinct()
    return out.unionByName(rest.join(named, key, "left").select(*rows.columns, F.coalesce(name, key).alias(name)))


def bed_cluster(calls: DataFrame, frac: float = 0.8, merge_coordinates: bool = False, cluster="cluster") -> DataFrame:
    """Cluster copy-number calls by reciprocal overlap within type; one row per (cluster, sample).

    Within a sample the widest range is kept; frequencies count samples of the whole input.
    """
    geo = ["chrom", "svtype", "start", "stop"]
    node = calls.groupBy(*geo).agg(F.min("name").alias("node"))
    lab = reciprocal_components(node, frac, "node", name="_cc")
    # name of a component = its smallest member name
    rows = calls.join(lab.select(*geo, F.col("_cc").alias(cluster)), geo)
    per = rows.groupBy(cluster, "chrom", "svtype", "sample").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("call_name"),
    )
    pre = rows.groupBy(cluster).agg(F.sqrt(F.var_pop("start") + F.var_pop("stop")).alias("pre_rmsstd"))
    post = per.groupBy(cluster).agg(
        F.count("*").alias("vac"), F.sqrt(F.var_pop("start") + F.var_pop("stop")).alias("post_rmsstd"),
        F.floor(F.percentile("start", F.lit(0.5))).alias("_ms"), F.floor(F.percentile("stop", F.lit(0.5))).alias("_me"),
    )
    total = calls.agg(F.count_distinct("sample").alias("_n"))
    out = per.join(pre, cluster).join(post, cluster)
    out = out.join(total, F.lit(True)) .withColumn("vaf", F.col("vac") / F.col("_n")).drop("_n")
    if merge_coordinates:
        out = out.withColumn("start", F.col("_ms")).withColumn("stop", F.col("_me"))
    return out.drop("_ms", "_me")


def defragment(calls: DataFrame, extend: float = 0.25) -> DataFrame:
    """Merge a sample's calls of one type whose extended ranges touch; keep the original extremes."""
    by = ["sample", "svtype", "chrom"]
    pad = F.floor((F.col("stop") - F.col("start")) * extend).cast("long")
    d = calls.withColumn("_s", F.col("start") - pad).withColumn("_e", F.col("stop") + pad)
    d = assign_islands(d, by=by, start="_s", stop="_e")
    return d.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_merged")).drop("island")
