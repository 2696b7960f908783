"""SimHash links and spaced seeds against brute force."""

import random
from itertools import combinations

import xxhash

from helixloom.llm import decontam, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    x = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    return x - (1 << 64) if x >> 63 else x


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
            parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_fingerprints(spark):
    rnd = random.Random(1)
    for t in [None, "", "A", "a b c", "a b c d", "É Ü x\u00a0y " * 5, " ".join(rnd.choice("abcdef") for _ in range(9000)), "İ K k"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def links_of(spark, fps, **kw):
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    return {(r["u"], r["v"]) for r in simhash.near_links(df, **kw).collect()}


def test_links_are_all_near_pairs(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(30):
        base = rnd.getrandbits(64)
        for _ in range(6):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    want = {(a, b) for a, b in combinations(sorted(fps), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert want and links_of(spark, fps) == want


def test_large_block_sets_keep_the_same_components(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(62)
    fps = {base}
    for _ in range(60):  # a cloud in which not all are near each other
        x = rnd.choice(sorted(fps))
        for b in rnd.sample(range(62), 3):
            x ^= 1 << b
        fps.add(x)
    got = {f: f for f in fps}
    links = links_of(spark, fps, bucket=3)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in links:
        got[root(a)] = root(b)
    want = brute_components(fps)
    assert {(root(a) == root(b)) == (want[a] == want[b]) for a in fps for b in fps} == {True}


def test_near_duplicates_edge_cases(spark):
    rows = [(5, None, None, None, None), (3, "", "", "", 0), (9, "same words here now again", "", "", 0), (7, "Same Words here now again", "", "", 0), (7, "Same Words here now again", "", "", 0), (None, "same words here now again", "", "", 0), (None, "lonely text of an unknown row", "", "", 0)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], DOC + ", fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 7), (7, 7), (7, 7), (None, 7), (None, None)], key=str)
    kept = simhash.dedup_stage(d)
    assert kept.columns == d.columns and {(r["doc_id"], r["text"]) for r in kept.collect()} == {(3, ""), (7, rows[3][1]), (None, rows[6][1])} and kept.count() == 3
    assert simhash.near_duplicates(d.limit(0)).count() == 0 and simhash.dedup_stage(d.limit(0)).count() == 0


def test_masks_are_lossless():
    for w in range(1, 21):
        window, k = decontam.rule(w)
        masks = decontam.masks_of(w)
        for bad in combinations(range(window), k):
            assert any(not {s + p for p in m} & set(bad) for m in masks for s in range(window - m[-1])), (w, bad)


def brute_overlaps(docs, items):
    out = set()
    for i, t in docs:
        d = decontam.words_of_text(t)
        for j, u in items:
            it = decontam.words_of_text(u)
            found = [o for diag in range(-len(it), len(d) + 1) if (o := decontam.overlap(d, it, diag))]
            if found:
                out.add((i, j, *min(found, key=lambda o: (-o[2], o[0], o[3]))))
    return out


def test_overlaps_match_brute_force(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([3, 7, 9, 10, 12, 15, 19, 20, 25, 60])] + [(98, None), (99, "")]
    docs = []
    for k in range(120):
        it = rnd.choice(items[:10])[1].split()
        it = [w if rnd.random() > 0.15 else "zz" for w in it][rnd.randint(0, 3):]
        pre, post = ([rnd.choice(words) for _ in range(rnd.randint(0, 30))] for _ in range(2))
        docs.append((k, " ".join([*pre, *(w.upper() for w in it), *post])))
    docs += [(500, None), (501, ""), (502, items[9][1]), (502, items[9][1]), (None, items[9][1])]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([*items, items[9]], "item_id long, text string")
    rows = [tuple(r) for r in decontam.contaminated(d, b).collect()]
    assert set(rows) == brute_overlaps(docs, items) and len(rows) == len(set(rows)) + 1
    assert sum(1 for r in rows if r[0] is not None and r[0] < 120) > 30
    bad = {r[0] for r in rows}
    out = decontam.decontam_stage(d, b)
    assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in docs if i not in bad)
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0
