"""Hand-made edge cases and brute-force comparisons on small fixtures."""

import random

from pyspark.sql import functions as F

from helixloom.functions.stats import ln_poisson_cdf, norm_cdf
from helixloom.operators import cleanup as cu
from helixloom.operators import cluster as cl
from helixloom.operators import intervals as iv
from helixloom.operators import merge as mg
from helixloom.operators.graph import connected_components
from helixloom.operators.numbering import number_rows

IV = "chrom string, start long, stop long, name string"


def test_overlap_join_matches_brute_force(spark):
    rnd = random.Random(1)
    # lengths across all levels, including zero and bin-crossing intervals
    rows = [("c", s := rnd.randrange(200_000_000), s + rnd.choice([0, 1, 50, 32768, 40000, 2_000_000, 50_000_000]), f"n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, IV)
    got = {(r[0], r[1]) for r in iv.overlap_join(df, df).select("name_a", "name_b").collect()}
    want = {(a[3], b[3]) for a in rows for b in rows if a[1] < b[2] and b[1] < a[2]}
    n = iv.overlap_join(df, df).count()
    assert got == want and n == len(want)


def test_reciprocal_join_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = [("c", s := rnd.randrange(3000), s + rnd.randrange(0, 900), f"n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, IV).withColumn("svtype", F.lit("DEL"))
    for f in (0.005, 0.01, 0.02, 0.04, 0.1, 0.5, 0.8, 1.0):
        got = sorted((r[0], r[1]) for r in iv.reciprocal_join(df, df, f).select("name_a", "name_b").collect())
        want = sorted(
            (a[3], b[3]) for a in rows for b in rows
            if (o := min(a[2], b[2]) - max(a[1], b[1])) > 0 and o >= f * (a[2] - a[1]) and o >= f * (b[2] - b[1])
        )
        assert got == want


def test_merge_touching_and_gap(spark):
    df = spark.createDataFrame([("c", 0, 10, "a"), ("c", 10, 20, "b"), ("c", 25, 30, "c"), ("d", 5, 6, "d"), ("c", 3 << 20, (3 << 20) + 5, "e"), ("c", 28, (3 << 20) + 1, "f")], IV)
    got = sorted(tuple(r) for r in iv.merge_intervals(df).collect())
    assert got == [("c", 0, 20), ("c", 25, (3 << 20) + 5), ("d", 5, 6)]
    assert sorted(tuple(r) for r in iv.merge_intervals(df, max_gap=5).collect()) == [("c", 0, (3 << 20) + 5), ("d", 5, 6)]


def test_components_chain_hub_and_copies(spark):
    chain = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)]
    hub = [("hub", f"z{i}") for i in range(200)]
    e = spark.createDataFrame(chain + hub + hub + [("x", "x")], "u string, v string")
    assert connected_components(e.where("u = 'nothing'")).count() == 0
    cc = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert len(cc) == 61 + 201
    assert {v for k, v in cc.items() if k.startswith("a")} == {"a000"}
    assert {v for k, v in cc.items() if k.startswith("z") or k == "hub"} == {"hub"}


def test_single_linkage_distance_is_strict_and_diagonal(spark):
    rnd = random.Random(3)
    pts = [(f"p{i}", "c", rnd.randrange(600), "c", rnd.randrange(600)) for i in range(120)] + [("q0", "k", 0, "k", 0), ("q1", "k", 10, "k", 0), ("q2", "k", 9, "k", 9)]
    df = spark.createDataFrame(pts, "name string, chr_a string, pos_a long, chr_b string, pos_b long")
    got = {r["name"]: r["cluster"] for r in cl.slink(df, 10).collect()}
    lab = {p[0]: p[0] for p in pts}

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for a in pts:
        for b in pts:
            if a[1] == b[1] and abs(a[2] - b[2]) < 10 and abs(a[4] - b[4]) < 10:
                lab[find(a[0])] = find(b[0])
    groups = {}
    for p in pts:
        groups.setdefault(find(p[0]), []).append((p[2], p[0]))
    want = {n: min(g)[1] for g in groups.values() for _, n in g}
    assert got == want


def test_nearest_and_numbering(spark):
    p = spark.createDataFrame([("c", 5), ("c", 5), ("c", 3 << 20)], "chrom string, pos long")
    r = spark.createDataFrame([("c", 1), ("c", 9)], "chrom string, pos long")
    assert sorted(tuple(x) for x in iv.neighbours(p, r).collect()) == [("c", 5, 1, 9), ("c", 3 << 20, 9, None)]
    d = number_rows(spark.range(1000).select((F.col("id") % 2).alias("g"), "id"), ["g"], ["id"], "n", 7)
    assert all(x["n"] == x["id"] // 2 + 1 for x in d.collect())


def test_insertion_subclass_is_order_dependent(spark):
    rows = [("u", "c", "c", 100, 101, "INS", "+-", -1, "<INS>"), ("d", "c", "c", 110, 111, "INS", "+-", -1, "<INS:ME:ALU>"), ("s", "k", "k", 100, 101, "INS", "+-", -1, "<INS:ME:ALU>"), ("t", "k", "k", 110, 111, "INS", "+-", -1, "<INS>")]
    df = spark.createDataFrame(rows, "vid string, chrom string, chr2 string, pos long, stop long, svtype string, strands string, svlen long, alt string")
    got = {r["vid"]: r["cluster"] for r in cl.cluster_sites(df, 300, 0.5).select("vid", "cluster").collect()}
    assert got == {"u": "u", "d": "u", "s": "s", "t": "t"}


def test_redundant_multiallelics_matches_greedy(spark):
    rnd = random.Random(4)
    rows = [(f"m{i:02d}", "c", s := rnd.randrange(1, 2000), s + rnd.randrange(20, 900)) for i in range(60)]
    df = spark.createDataFrame(rows, "vid string, chrom string, pos long, stop long")
    got = {r["vid"] for r in cu.redundant_multiallelics(df).collect()}
    iv_ = sorted(((e - (s - 1), v, s - 1, e) for v, _, s, e in rows), key=lambda x: (-x[0], x[1]))
    dead = set()
    for i, (la, a, s0, e0) in enumerate(iv_):
        if a in dead:
            continue
        for lb, b, s1, e1 in iv_[i + 1:]:
            if min(e0, e1) - max(s0, s1) > 0.5 * lb:
                dead.add(b)
    assert got == dead


def test_stitching_chain(spark):
    s = spark.createDataFrame(
        [("a", "c", 1, 1000, "DEL", "RD", "PASS"), ("b", "c", 1100, 2000, "DEL", "RD", "PASS"), ("d", "c", 2150, 3000, "DEL", "RD", "PASS"), ("x", "c", 1100, 2000, "DEL", "PE,RD", "PASS"), ("y", "c", 9000, 9900, "DEL", "RD", "PASS")],
        "vid string, chrom string, pos long, stop long, svtype string, evidence string, filter string",
    )
    g = spark.createDataFrame([(v, "S1", 0, 1) for v in "abdxy"], "vid string, sample string, a1 int, a2 int")
    got = sorted(tuple(r) for r in mg.stitch_fragments(s, g).select("vid", "pos", "stop", "members").collect())
    assert got == [("a", 1, 3000, "a,b,d"), ("y", 9000, 9900, "y")]


def test_copy_number_rules_small_pile(spark):
    s = spark.createDataFrame([("big", "DEL", "c", 1, 20001), ("small", "DEL", "c", 5001, 12001)], "vid string, svtype string, chrom string, pos long, stop long")
    g = spark.createDataFrame([("big", "S", 1, 0, 1, 3), ("small", "S", 0, 0, 1, 1)], "vid string, sample string, rd_cn int, a1 int, a2 int, ev int")
    none = spark.createDataFrame([], "vid string")
    # the wider call has depth and read support and explains one of the lost copies of the narrower one
    assert [tuple(r) for r in cu.copy_number_revisions(s, g, none).collect()] == [("small", "S", 1)]


def test_statistics(spark):
    import math

    d = spark.createDataFrame([(0.0, 3.0), (2.0, 5.0), (4.5, 100.0), (900.0, 1000.0), (2000.0, 10.0)], "k double, mu double")
    for r in d.select("k", "mu", F.exp(ln_poisson_cdf(F.col("k"), F.col("mu"))).alias("p")).collect():
        want = sum(math.exp(-r["mu"] + i * math.log(r["mu"]) - math.lgamma(i + 1)) for i in range(int(r["k"]) + 1))
        assert abs(r["p"] - want) < 1e-9
    z = spark.createDataFrame([(-3.0,), (0.0,), (1.5,)], "z double")
    for r in z.select("z", norm_cdf(F.col("z")).alias("p")).collect():
        assert abs(r["p"] - 0.5 * math.erfc(-r["z"] / 2**0.5)) < 1e-6


def _stitched(spark, rows, **kw):
    """rows: (vid, pos, stop, svtype, evidence, filter, genotypes)"""
    s = spark.createDataFrame([(v, "chr1", t, p, e, ev, fl) for v, p, e, t, ev, fl, _ in rows], "vid string, chrom string, svtype string, pos long, stop long, evidence string, filter string")
    g = spark.createDataFrame([(v, f"s{i}", *x) for v, *_, gt in rows for i, x in enumerate(gt)], "vid string, sample string, a1 int, a2 int")
    return sorted((r["vid"], r["pos"], r["stop"], r["members"]) for r in mg.stitch_fragments(s, g, **kw).collect())


def test_stitching_rules(spark):
    gt, other = [(0, 0), (0, 1)], [(0, 1), (0, 1)]
    up = ("u", 1000, 1999, "DEL", "RD", "PASS", gt)
    down = lambda pos=2399, stop=3399, t="DEL", ev="RD", fl="PASS", g=gt: ("v", pos, stop, t, ev, fl, g)
    joined = [("u", 1000, 3399, "u,v")]
    assert _stitched(spark, [up, down()]) == joined and _stitched(spark, [up, down(ev="BAF")]) == joined
    apart = [down(pos=2400), down(t="DUP"), down(pos=1799), down(pos=1899, stop=2399), down(g=other), down(g=[(0, 0), (None, 1)])]
    for d in apart:  # padded spans only touch, types, too much overlap of either, genotypes
        assert len(_stitched(spark, [up, d])) == 2
    for d in [down(ev="PE"), down(ev="BAF,SR"), down(fl="X,MULTIALLELIC,Y"), down(t="INS"), down(stop=2000)]:  # no candidates
        assert [x[0] for x in _stitched(spark, [up, d])] == ["u"]
    chain = [(f"c{i}", 1000 + 1300 * i, 1999 + 1300 * i, "DEL", "RD", "PASS", gt) for i in range(6)]
    assert _stitched(spark, chain) == [("c0", 1000, 8499, "c0,c1,c2,c3,c4,c5")]


def test_copy_number_revisions_match_an_ordered_pass(spark):
    rnd = random.Random(11)
    sites, genos = [], []
    for i in range(60):
        a = rnd.randrange(1, 900_000)
        sites.append((f"v{i:02d}", "chr1", rnd.choice(["DEL", "DUP"]), a, a + rnd.choice([6000, 9000, 20_000, 50_000])))
        for s in ("s1", "s2", "s3"):
            genos.append((f"v{i:02d}", s, 0, rnd.choice([0, 1, 1]), rnd.choice([0, 1, 1, 3, 4, 5]), rnd.choice([1, 1, 3, 5, 7, 2])))
    multi = {f"v{i:02d}" for i in range(0, 60, 9)}
    sd = spark.createDataFrame(sites, "vid string, chrom string, svtype string, pos long, stop long")
    gd = spark.createDataFrame(genos, "vid string, sample string, a1 int, a2 int, rd_cn int, ev int")
    got = {(r["vid"], r["sample"]): r["rd_cn"] for r in cu.copy_number_revisions(sd, gd, spark.createDataFrame([(m,) for m in multi], "vid string")).collect()}
    at = {v: (t, p - 1, e) for v, _, t, p, e in sites}
    want = {}
    for s in ("s1", "s2", "s3"):
        own = {v: (cn, ev, a2 > 0) for v, x, _, a2, cn, ev in genos if x == s and (cn < 2 if at[v][0] == "DEL" else cn > 2)}
        pairs = []
        for a in own:
            for b in own:
                (ta, sa, ea), (tb, sb, eb) = at[a], at[b]
                if a != b and own[a][2] and sa < eb and sb < ea and (not own[b][2] or ea - sa >= eb - sb):
                    pairs.append((-(ea - sa), -(eb - sb), sa, a, sb, b, min(ea, eb) - max(sa, sb)))
        cn, normal, new = {v: x[0] for v, x in own.items()}, set(), {}
        for la, lb, _, a, _, b, shared in sorted(pairs):
            if a in normal or not shared > 0.5 * -lb:
                continue
            (da, ma), (db, mb) = ((own[x][1] & 1 > 0, own[x][1] & 6 > 0) for x in (a, b))
            hit = None
            if da and ma and db and not mb and a not in multi:
                hit = (b, cn[b] + 2 - cn[a])
            elif da and not ma and db and mb and b not in multi and own[b][2] and shared > 0.5 * -la:
                hit = (a, cn[a] + 2 - cn[b])
            elif da and not ma and db and not mb and at[a][0] == at[b][0] and a not in multi:
                more = cn[a] == 0 and cn[b] != 0 or cn[a] == 1 and cn[b] == 0 or 1 < cn[a] < cn[b]
                hit = (b, cn[b] + 2 - cn[a] if more else 2)
            elif da and -lb > 5000 and a not in multi:
                hit = (b, cn[b] + 2 - cn[a])
            if hit:
                new[hit[0]] = cn[hit[0]] = max(hit[1], 0)
                normal |= {hit[0]} if cn[hit[0]] == 2 else set()
        want |= {(v, s): c for v, c in new.items()}
    assert len(want) > 10 and got == want


def test_related_samples_are_pruned_to_the_end(spark):
    from helixloom.operators import batch as bt

    rnd = random.Random(12)
    pairs = {(f"p{i:03d}", f"p{i + 1:03d}") for i in range(30)} | {tuple(sorted(rnd.sample([f"q{i}" for i in range(25)], 2))) for _ in range(60)}
    left, want = set(pairs), set()
    while left:
        deg = {}
        for a, b in left:
            deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
        worst = min(deg, key=lambda x: (-deg[x], x))
        want.add(worst)
        left = {p for p in left if worst not in p}
    got = {r["sample"] for r in bt.prune_related(spark.createDataFrame(sorted(pairs), "a string, b string")).collect()}
    assert got == want


def test_vcf_round_trip_on_files(spark, tmp_path):
    from helixloom.sources import vcf

    names = ["s2", "s10", "s1"]
    sites = spark.createDataFrame(
        [("chr2", 5, "b", "<DEL>", 7.0, "PASS", 50, "DEL", "chr2", "+-", 45, "manta", "PE,SR", None, None), ("chr1", 9, "a", "<DUP>", None, "X,Y", 90, "DUP", "chr1", "-+", 81, "depth", "RD", None, None), ("chr1", 3, "c", "<INS>", 1.0, None, 4, "INS", "chr1", "+-", -1, "melt", "SR", "dDUP", "DUP_chr1:1-2")],
        "chrom string, pos long, vid string, alt string, qual double, filter string, stop long, svtype string, chr2 string, strands string, svlen long, algorithms string, evidence string, cpx_type string, cpx_intervals string")
    genos = spark.createDataFrame([("b", "s1", 0, 1, 30, 1), ("b", "s10", None, None, None, None), ("a", "s2", 1, 1, 99, 4)], "vid string, sample string, a1 int, a2 int, gq int, rd_cn int")
    path = str(tmp_path / "out")
    vcf.write_vcf(vcf.to_vcf_lines(sites, genos, names), path, vcf.merge_headers(vcf.header_lines(names[:1], ["chr1"]), vcf.header_lines(names[1:], ["chr1", "chr2"])))
    s, g = vcf.read_vcf(spark, path)
    cols = ["vid", "chrom", "pos", "stop", "svlen", "svtype", "chr2", "strands", "alt", "qual", "algorithms", "evidence", "cpx_type", "cpx_intervals"]
    assert sorted(map(tuple, s.select(*cols).collect()), key=str) == sorted(map(tuple, sites.select(*cols).collect()), key=str)
    want = {(v, n): (None, None, None, None) for v in "abc" for n in names}
    want |= {(r["vid"], r["sample"]): (r["a1"], r["a2"], r["gq"], r["rd_cn"]) for r in genos.collect()}
    assert {(r["vid"], r["sample"]): (r["a1"], r["a2"], r["gq"], r["rd_cn"]) for r in g.collect()} == want and g.count() == 9
    vcf.write_sites(sites, str(tmp_path / "sites"))
    assert spark.read.parquet(str(tmp_path / "sites")).where("chrom = 'chr1'").count() == 2


def test_bin_counts_on_a_stream(spark, tmp_path):
    import datetime as dt

    from helixloom.streaming.bincov_stream import stream_bin_counts

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(at(1), "c", 0, 150, "s", False, False, True), (at(2), "c", 120, 180, "s", False, False, True), (at(3), "c", 120, 180, "s", True, False, True), (at(59), "c", 0, 1, "s", False, False, False)]
    schema = "ts timestamp, chrom string, start long, stop long, sample string, duplicate boolean, secondary boolean, mapped boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream_bin_counts(stream).writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["bin"], r["cov"]) for r in spark.table("bins").collect()} == {(0, 1), (1, 2)}


def test_overlap_totals_against_pairs(spark):
    rng = random.Random(11)

    def rows(n):
        out = []
        for i in range(n):
            s = rng.choice([None, *range(40)]) if i % 9 == 0 else rng.randrange(200_000) if i % 2 else rng.randrange(40)
            e = None if s is None or i % 23 == 0 else s + rng.choice([-3, 0, 0, 1, 5, 30, 70_000])
            out.append((f"n{i // 2}", rng.choice(["c1", "c2", None]), s, e))
        return out

    a, b = rows(300), rows(250)
    hit = lambda x, y: None not in (*x[1:], *y[1:]) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3]
    want = sorted(((*x, sum(hit(x, y) for y in b), sum(min(x[3], y[3]) - max(x[2], y[2]) for y in b if hit(x, y))) for x in a), key=str)
    da, db = (spark.createDataFrame(r, "name string, chrom string, start long, stop long") for r in (a, b))
    assert sorted(map(tuple, iv.overlap_totals(da, db).collect()), key=str) == want
    assert sorted(map(tuple, iv.overlap_left_join(da, db, key=["name"], totals=True).collect()), key=str) == want
    inner = iv.overlap_join(da, db, totals=True)
    assert inner.columns == ["name_a", "chrom_a", "start_a", "stop_a", "n_b", "bases_b"]
    assert sorted(map(tuple, inner.collect()), key=str) == [x for x in want if x[4]]
    assert sum(x[4] for x in want) == iv.overlap_join(da, db).count() > 1000


def test_overlap_totals_form_no_pairs(spark):
    n = 20_000  # 4 * 10^8 pairs
    d = spark.range(n).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("c1").alias("chrom"), F.lit(0).cast("long").alias("start"), (F.col("id") + n).alias("stop"))
    r = iv.overlap_left_join(d, d, key=["name"], totals=True).agg(F.sum("n_b"), F.sum("bases_b")).first()
    assert r[0] == n * n and r[1] == sum((2 * (n - 1 - k) + 1) * (n + k) for k in range(n))


def test_site_clusters_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(700):
        t = rng.choice(["DEL", "DEL", "INS", "INS", "BND"])
        p = rng.choice([rng.randrange(1500), rng.randrange(60_000)])
        n = rng.choice([0, 1, 20, 90, 400, 1500, 2500, 6000]) + rng.randrange(40)
        chr2 = "c2" if t == "BND" else "c1"
        stop, svlen = (p + 1, rng.choice([-1, n, n, None])) if t == "INS" else (p + n, n)
        alt = rng.choice(["<INS>", "<INS:ME:ALU>", "<INS:ME:L1>", None]) if t == "INS" else f"<{t}>"
        rows.append((rng.choice([f"v{i:03d}"] * 12 + [f"v{i - 1:03d}", None]), rng.choice(["c1"] * 15 + [None]), chr2, None if i % 97 == 5 else p, stop, t, rng.choice(["+-", "+-", "-+"]), svlen, alt))
    cols = ["vid", "chrom", "chr2", "pos", "stop", "svtype", "strands", "svlen", "alt"]
    d = spark.createDataFrame(rows, "vid string, chrom string, chr2 string, pos long, stop long, svtype string, strands string, svlen long, alt string")

    def clusters(dist, frac):
        end = lambda r: None if r["svtype"] == "INS" and r["svlen"] is None else r["pos"] + r["svlen"] if r["svtype"] == "INS" else r["stop"]
        free = lambda r: r["chrom"] != r["chr2"] or r["svtype"] == "INS" and r["svlen"] == -1
        recs = [dict(zip(cols, r)) for r in rows]
        recs = [r for r in recs if r["vid"] and r["chrom"] and r["pos"] is not None]
        root = {r["vid"]: r["vid"] for r in recs}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a in recs:
            for b in recs:
                if (a["pos"], a["vid"]) >= (b["pos"], b["vid"]) or any(a[c] != b[c] for c in ("chrom", "chr2", "svtype", "strands")):
                    continue
                if b["pos"] - a["pos"] >= dist or abs(a["stop"] - b["stop"]) >= dist:
                    continue
                if a["svtype"] == "INS" and a["alt"] != "<INS>" and (a["alt"] is None or a["alt"] != b["alt"]):
                    continue
                if frac > 0 and not (free(a) or free(b)):
                    if end(a) is None or end(b) is None:
                        continue
                    ov = min(end(a), end(b)) - max(a["pos"], b["pos"])
                    if ov <= 0 or ov < frac * max(end(a) - a["pos"], end(b) - b["pos"]):
                        continue
                x, y = sorted((find(a["vid"]), find(b["vid"])))
                root[y] = x
        return {v: find(v) for v in root}

    for dist, frac in ((300, 0.5), (60, 0.8), (1, 0.1), (2000, 0.0)):
        want = clusters(dist, frac)
        rep = d.withColumn("_end", F.when(F.col("svtype") == "INS", F.col("pos") + F.col("svlen")).otherwise(F.col("stop")))
        rep = rep.withColumn("_free", (F.col("chrom") != F.col("chr2")) | ((F.col("svtype") == "INS") & (F.col("svlen") == -1)))
        got = {r["vid"]: r["_cc"] for r in cl._cell_components(rep, ["chrom", "chr2", "svtype", "strands"], dist, frac).where("chrom IS NOT NULL AND pos IS NOT NULL").collect()}
        assert got == want and (dist == 1 or 1 < len(set(want.values())) < len(want))


def test_dense_sites_make_no_pairs(spark):
    n = 40_000  # 8 * 10^8 pairs, all linked
    d = spark.range(n).select(F.format_string("v%06d", "id").alias("vid"), (1000 + F.col("id") % 200).alias("pos"), (9000 + F.floor(F.col("id") / 200)).alias("stop"))
    d = d.withColumns({"chrom": F.lit("c1"), "chr2": F.lit("c1"), "svtype": F.lit("DEL"), "strands": F.lit("+-"), "alt": F.lit("<DEL>"), "svlen": F.col("stop") - F.col("pos")})
    got = cl.cluster_sites(d, 300, 0.5).groupBy("cluster").count().collect()
    assert [tuple(r) for r in got] == [("v000000", n)]


def test_vcf_lines_are_made_once_when_parsed(spark):
    from helixloom.sources import vcf

    rows = [("v1", "chr1", 5, 9, 4, "DEL", "chr1", "+-", "<DEL>", 1.0, "PASS", "depth", "RD", None, None), ("v2", "chr1", 7, 9, 2, "DUP", "chr1", "-+", "<DUP>", 1.0, "A,B", "depth", "RD", None, None)]
    sites = spark.createDataFrame(rows, "vid string, chrom string, pos long, stop long, svlen long, svtype string, chr2 string, strands string, alt string, qual double, filter string, algorithms string, "
                                  "evidence string, cpx_type string, cpx_intervals string")
    gts = spark.createDataFrame([("v1", "S2", 0, 1, 9, 2), ("v1", "S2", 0, 0, 8, 2), ("v1", "S0", None, None, 7, None)], "vid string, sample string, a1 int, a2 int, gq int, rd_cn int")
    lines = vcf.to_vcf_lines(sites, gts, ["S0", "S1", "S2"])
    cells = {r["value"].split("\t")[2]: r["value"].split("\t")[9:] for r in lines.collect()}
    assert cells == {"v1": ["./.:7:.", "./.:.:.", "0/0:8:2"], "v2": ["./.:.:."] * 3}  # the smaller of two cells of a sample, the null cell elsewhere
    for d in vcf.parse_vcf_lines(lines.select("value"), ["S0", "S1", "S2"]):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sort_array(") + plan.count("array_sort(") == 1
