"""Importance resampling, Grace deduplication and whitening against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np

from helixloom.llm import exact_dedup, importance, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_span_crcs():
    rnd = random.Random(1)
    data = rnd.randbytes(300_000)
    lengths = [rnd.choice([1, 2, 63, 64, 65, 128, 129, 1023, 1024, 4095, 4096, 4097, 9000]) for _ in range(400)] + [262_143, 262_144, 262_145, 270_000]
    starts = [rnd.randrange(0, 300_000 - n) for n in lengths]
    got = importance.span_crcs(np.frombuffer(data, np.uint8), np.array(starts), np.array(lengths))
    assert got.tolist() == [zlib.crc32(data[s:s + n]) for s, n in zip(starts, lengths)]
    assert len(importance.span_crcs(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0


def features(text, runs):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)], len(w)


def brute_draw(docs, target, runs, buckets, percent, least):
    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for f in features(t, runs)[0]:
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, x in docs:
        fs, words = features(x, runs)
        w = math.floor(sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) / len(fs)) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=str)


def test_draw_matches_brute_force(spark):
    rnd = random.Random(2)
    words = ["Alpha", "béta", "gamma9", "δ", "x" * 70, "y" * 5000, "漢字", " ", "9"]
    docs = [(i, "".join(rnd.choice(words) + rnd.choice([" ", "\n", "-", "\x7f", "!? "]) for _ in range(rnd.randrange(0, 40)))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, "..."), (7, "again again"), (7, "again again"), (None, "alpha " * 30), (90, "one word " * 40_000), (91, "z" * 3_000_000)]
    target = ["gamma9 δ 9", "alpha alpha", None, ""]
    d = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, weight int").repartition(5)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    for runs, percent, least in ((1, 10, 20), (3, 100, 0)):
        got = importance.resample(d, b, runs, 50, percent, least)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_draw(docs, target, runs, 50, percent, least)
    assert importance.resample(d.limit(0), b).count() == 0
    assert {r["weight"] for r in importance.resample(d, b.limit(0), 1, 50).collect()} != {0}


def brute_groups(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(t or "", []).append(i)
    out, seen = [], set()
    for i, t in docs:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        first = i == keep and (t or "") not in seen
        if first:
            seen.add(t or "")
        out.append((i, keep, len(ids), first, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_deduplication_matches_brute_force(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    docs = [(i, rnd.choice(["a", "b ", "b", "ü" * 300, "long " * 500]) + str(rnd.randrange(40))) for i in range(600)]
    docs += [(1000 + i, "hot") for i in range(400)] + [(None, "hot"), (5000, None), (5001, ""), (5001, ""), (None, "alone"), (None, "alone"), (5002, "x" * 2_000_000), (5003, "x" * 2_000_000)]
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, keep_id string, h int").repartition(6)
    want = brute_groups(docs)
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(7))
    for args in ({}, {"fit": 3000, "collapse": 2000, "buckets": 2}, {"key": weak}, {"key": weak, "fit": 5000, "buckets": 1}):  # the second and the last take several levels
        assert sorted((tuple(r) for r in exact_dedup.deduplicate(d, **args).collect()), key=str) == want, args
    assert exact_dedup.deduplicate(d.limit(0)).count() == 0


def test_content_table_tells_equal_hashes_apart():
    t = exact_dedup.ContentTable(1 << 20)
    for i in range(3000):
        assert t.add(i % 3, b"%d" % (i % 1500), 1, i, 1)
    assert len(t.keys) == 1500 and set(t.rows) == {2} and t.best == list(range(1500, 3000))
    full = exact_dedup.ContentTable(1)
    assert full.add(1, b"any", 1, None, 1) and not full.add(2, b"more", 1, 1, 1) and full.add(1, b"any", 2, 4, 1) and full.best == [4]


def reference(vectors, count):
    u = np.unique(vectors, axis=0)
    n, s = len(u), u.sum(0)
    y = u - s / n
    e, w = np.linalg.eigh(y.T @ y / n)
    return n, s, e[::-1][:count], w[:, ::-1][:, :count], e.sum()


def check_whitening(spark, x, count):
    d = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = whitening.whiten(d, count).collect()
    q = np.floor(np.float32(x).astype(float) * 256)
    n, s, e, w, trace = reference(q, count)
    assert len(got) == len(x) * len(e)
    z = np.zeros((len(x), len(e)))
    for r in got:
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] * trace / e[r["component"] - 1] - 1) < 1e-9
        assert r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(q[r["vec_id"]], s))
    want = (q - s / n) @ (w / np.sqrt(e))
    sign = np.sign((z * want).sum(0))
    assert np.abs(z - want * sign).max() < 1e-7


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(5)
    check_whitening(spark, rng.normal(size=(900, 48)) / 8, 4)  # a flat spectrum: the filter has to work
    x = rng.normal(size=(300, 6))
    check_whitening(spark, np.concatenate([x, np.repeat(x[:1], 200, 0)]), 3)  # a vector that many rows share
    check_whitening(spark, rng.normal(size=(40, 2)), 4)  # fewer dimensions than components


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [1.0]), (5, []), (6, [1.0, 2.0]), (7, [2.0, -1.0]), (7, [2.0, -1.0]), (None, [0.5, 0.25]), (8, [0.0, 3.0])]
    d = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, x string")
    out = whitening.whiten(d).collect()
    assert sorted((r["vec_id"], r["component"]) for r in out if r["vec_id"] is not None) == sorted((i, c) for i in (6, 7, 7, 8) for c in (1, 2)) and len(out) == 10
    assert whitening.whiten(d.limit(0)).count() == 0 and whitening.whiten(d.where("vec_id = 7")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    big = spark.createDataFrame([(i, [float(i) * 1e15, 1.0 * i * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(big).collect()} >= {None}
