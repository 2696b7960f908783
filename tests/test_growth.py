"""Small inputs on which operators failed or took work that grows faster than their rows."""

import random

from pyspark.sql import functions as F

from helixloom.operators import cluster as cl
from helixloom.operators import evidence as ev
from helixloom.operators import intervals as iv
from helixloom.operators import resolve as rs
from helixloom.operators import stitch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_use_frames_that_only_grow(spark):
    rnd = random.Random(5)
    pts, refs = [("c", rnd.randrange(3 << 20)) for _ in range(200)], [("c", rnd.randrange(3 << 20)) for _ in range(60)]
    p, r = (spark.createDataFrame(x, "chrom string, pos long") for x in (pts, refs))
    d = iv.neighbours(p, r)
    assert "unboundedfollowing" not in plan_of(d)
    at = sorted({x for _, x in refs})
    want = {x: (max((y for y in at if y <= x), default=None), min((y for y in at if y >= x), default=None)) for _, x in pts}
    assert {x["pos"]: (x["prev_pos"], x["next_pos"]) for x in d.collect()} == want


def test_depth_of_an_interval_without_controls(spark):
    """All samples are carriers: they are compared with the default copy number."""
    iv_ = spark.createDataFrame([("v", "DEL", "chr1", 0, 5000), ("w", "DEL", "chr1", 0, 5000)], "vid string, kind string, chrom string, start long, stop long")
    g = spark.createDataFrame([("v", "a", 1), ("v", "b", 1), ("w", "a", 1), ("w", "b", 3)], "vid string, sample string, rd_cn int")
    c = spark.createDataFrame([("v", "a"), ("v", "b"), ("w", "a")], "vid string, sample string")
    s = spark.createDataFrame([("a", "MALE"), ("b", "FEMALE")], "sample string, sex string")
    got = {r["vid"]: (r["case_del"], r["case_wt"], r["ctrl_wt"], r["assessment"]) for r in rs.assess_depth(iv_, g, c, s).collect()}
    assert got == {"v": (2, 0, 0, "DEL"), "w": (1, 0, 1, "DEL")}


def test_dense_fragments_are_scanned_by_few_states(spark):
    """Records that end alike go on alike: the scan holds their states, not each of them."""
    rnd = random.Random(6)
    rows = [(f"f{i:04d}", s, s + rnd.randrange(50, 10_000, 200)) for i, s in enumerate(sorted(rnd.randrange(400_000) for _ in range(1200)))]
    rows = [(v, "g", s, e, min(2000, (e - s) // 5), (e - s) // 5) for v, s, e in rows]
    rows += [(rows[i][0], "g", *rows[i + 1][2:]) for i in (10, 700)]  # a name that comes twice
    scan, live, want = stitch._Scan(0, "g", 2000), [], {}
    for v, _, s, e, pad, slack in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        scan.add(s, e, pad, slack, v)
        on = [o for o in live if o[1] + o[2] > s - pad and min(o[1], e) - s <= min(o[3], slack)]
        for o in on:
            o[1], o[2], o[3] = e, max(o[2], pad), max(o[3], slack)
        if not on:
            live.append([v, e, pad, slack])
        for h in [o[0] for o in on] or [v]:
            want.setdefault(h, []).append((s, e, v))
    assert len(scan.open) < 100 < sum(o[1] + o[2] >= rows[-3][2] - 2000 for o in live)
    want = {(h, m[0][0], m[-1][1], ",".join(v for _, _, v in m)) for h, m in ((h, sorted(m)) for h, m in want.items())}
    d = spark.createDataFrame(rows, "vid string, grp string, start long, stop long, pad long, slack long")
    for parts in (1, 5):
        got = [(r["head"], r["pos"], r["stop"], r["members"]) for r in stitch.stitched(d, 2000, parts).collect()]
        assert len(got) == len(want) and set(got) == want


def _roots(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_reciprocal_components_without_pairs(spark):
    """Names that repeat are one node; intervals without length link nothing; dense copies make few edges."""
    rnd = random.Random(7)
    schema = "name string, chrom string, svtype string, start long, stop long"
    for frac, reach in ((0.8, 6000), (0.5, 60_000), (0.95, 900), (1.0, 60)):
        rows = [(f"n{i:03d}", rnd.choice("cd"), "DEL", s := rnd.randrange(reach), s + int(2 ** rnd.uniform(0, 12))) for i in range(220)]
        rows += [(f"z{i}", "c", "DEL", 5, 5) for i in range(3)] + [("z9", None, "DEL", 5, 50), ("n003", "c", "DEL", 90, 190), rows[7], ("z0", "d", "DEL", 10, 9), (None, "c", "DEL", 90, 190)]
        known = [r for r in rows if None not in r and r[4] > r[3]]
        linked = [(a[0], b[0]) for a in known for b in known if a[1] == b[1] and (o := min(a[4], b[4]) - max(a[3], b[3])) > 0 and o >= frac * (a[4] - a[3]) and o >= frac * (b[4] - b[3])]
        want = _roots({r[0] for r in rows if r[0]}, linked)
        got = cl.reciprocal_components(spark.createDataFrame(rows, schema), frac).collect()
        assert len(got) == len(rows) and {(r["name"], r["component"]) for r in got} == {*want.items(), (None, None)}


def test_balance_totals_are_the_counts_of_the_windows(spark):
    """Also long events, whose middle alone counts, events that come twice, samples without a name and places without SNPs."""
    rnd = random.Random(8)
    events = [(f"v{i:02d}", rnd.choice("cde"), s := rnd.randrange(-20, 3000), s + rnd.choice([0, 1, 5, 90, 700, 1500])) for i in range(60)]
    events += [events[3], ("v03", "c", 10, 60), (None, "c", 500, 900), ("v99", None, 1, 50), ("v98", "c", 900, 800)]
    snps = [(rnd.choice("cd"), rnd.randrange(1, 4000), 0.5, rnd.choice(["S1", "S2", "S3", None])) for _ in range(600)] + [(None, 5, 0.5, "S1"), ("c", None, 0.5, "S1")]
    e = spark.createDataFrame(events, "vid string, chrom string, start long, stop long")
    b = spark.createDataFrame(snps, "chrom string, pos long, baf double, sample string")
    for big in (600, 1_000_000):
        want = ev.balance_counts(ev.balance_windows(e, b, big))
        got = ev.balance_totals(e, b, big, tile=256)
        assert got.columns == want.columns and got.count() > 80
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        c = spark.createDataFrame([(f"v{i:02d}", s) for i in range(40) for s in ("S1", "S2")] + [("v01", "S1"), (None, "S1"), ("v05", None)], "vid string, sample string")
        w = b.withColumn("baf", F.col("pos") % 7 / 7.0)
        ks = ev.balance_ks(ev.balance_windows(e, w, big, inside=True, carriers=c)), ev.balance_ks(ev.balance_windows(e, w, big), c)
        assert ks[0].count() > 10 and sorted(map(tuple, ks[0].collect()), key=str) == sorted(map(tuple, ks[1].collect()), key=str)
        mid, whole = ev.balance_windows(e, b, big, inside=True), ev.balance_windows(e, b, big).where("region = 'inside'")
        assert sorted(map(tuple, mid.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
