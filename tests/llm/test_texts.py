"""Tokenising, chat, language model, extraction and licences: brute force and edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from helixloom.llm import bpe, brown, chat, html_text, licences

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "<|endoftext|>x y<|startoftext|> z", "é é b \x1c c", "don't we'll 123 45.6  　x", "x" * 5000, "́abc ́d", "\U0001f600\U0001f600 ok", "İstanbul ﬁ Σ"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, ids string, uid int")


def test_encoding_equals_the_tokenizer(spark):
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("abcdeé \n") for _ in range(6000)) for _ in range(4)]
    texts = ODD + ["".join(rnd.choice("xyz ü") for _ in range(rnd.randint(0, 900))) + rnd.choice(passages)[rnd.randint(0, 99):] + "".join(rnd.choice("uvw ") for _ in range(rnd.randint(0, 300))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, "a"), (None, passages[0]), (None, passages[0])]
    t = bpe.Encoder.at(PATH).tokenizer
    got = bpe.encode_documents(docs(spark, rows), PATH).collect()
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), t.decode(ids, skip_special_tokens=False)))
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == Counter(want)
    digests = bpe.encode_documents(docs(spark, rows), PATH, bpe.DIGESTS).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert Counter(map(tuple, digests)) == Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(text)) for i, ids, text in want)
    assert bpe.encode_documents(docs(spark, []), PATH).count() == 0


def test_joins_are_repaired_wherever_a_text_is_cut():
    rnd, enc = random.Random(6), bpe.Encoder.at(PATH)
    for x in [*(o or "" for o in ODD), "the thing isn't over, they'll see " * 8]:
        b = x.encode()
        want = enc.ids(b)
        for _ in range(20):
            ends = sorted({c for c in (rnd.randrange(len(b) + 1) for _ in range(rnd.choice([1, 4, 30]))) if 0 < c < len(b) and b[c] & 0xC0 != 0x80}) + [len(b)]
            runs = [(s, e, enc.pieces(b[s:e])) for s, e in zip([0, *ends], ends) if e > s]
            assert [i for p in bpe.join_runs(enc, b, runs) for i in p[0]] == want


def test_cuts_depend_on_content_alone():
    rnd = random.Random(7)
    body = bytes(rnd.randrange(97, 123) for _ in range(40000))
    a, b = bpe.cuts(body), [c - 777 for c in bpe.cuts(bytes(777) + body)]
    assert len(set(a) & set(b)) >= 0.8 * len(a) > 10 and bpe.cuts(b"") == [] and bpe.cuts("é".encode() * 5)[-1] == 10


def test_plain_pieces_take_the_tokenizers_ids():
    rnd, enc = random.Random(13), bpe.Encoder.at(PATH)
    assert enc.plain
    letters = [chr(c) for c in range(0x41, 0x250) if bpe._PLAIN.fullmatch(chr(c))]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    pieces = letters + ["".join(rnd.choices(letters[:52] if k % 2 else letters, k=rnd.randint(1, 12))) + "".join(rnd.choices(marks, k=rnd.randint(0, 3))) for k in range(4000)]
    for p in pieces:
        assert [i for e in enc.pieces(p.encode()) for i in e[0]] == enc.ids(p.encode()), p


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def back(df):
    rows = df.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    return [(r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in rows]


def test_chat_escapes_can_be_undone(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\|", "<\\|", "<<|", "\\\\<|x", "", None, "\n\n", "é\U0001f600<|im_end|>", "<", "|im_end|>"]
    roles = ["user", "assistant", "a\nb", "\\n", "<|x", None]
    rows = [(1, t, roles[t % 6], x) for t, x in enumerate(nasty)] + [(2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (2, None, "user", "first"), (None, 1, "assistant", "x")]
    c = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, score string")
    got = {k: (t, loss) for k, t, loss in back(chat.format_conversations(chat.chains(c)))}
    assert got[1][0] == [(roles[t % 6] or "", x or "") for t, x in enumerate(nasty)]
    assert got[1][1] == "".join(x or "" for t, x in enumerate(nasty) if roles[t % 6] == "assistant")
    assert got[2] == ([("user", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], "aab") and got[None] == ([("assistant", "x")], "x")
    assert chat.format_conversations(chat.chains(c.limit(0))).count() == 0


def test_best_branches_of_reply_trees(spark):
    rnd = random.Random(8)
    rows, parent, score = [], {}, {}
    for root in range(6):
        ids = [f"{root}:0"]
        parent[ids[0]], score[ids[0]] = None, 0.0
        for k in range(1, 40):
            i = f"{root}:{k}"
            parent[i], score[i] = rnd.choice(ids[-6:]), rnd.random()
            ids.append(i)
    parent["lost"], score["lost"] = "nobody", 1.0
    parent["c1"], parent["c2"], score["c1"], score["c2"] = "c2", "c1", 1.0, 1.0  # a circle
    rows = [(1, i, p, "assistant" if score[i] > 0.5 else "user", i, score[i]) for i, p in parent.items()]
    m = spark.createDataFrame(rows + rows[:3], "conv_id long, msg_id string, parent_id string, role string, text string, score double")

    def path(i):
        out = []
        while i is not None and i in parent:
            out.append(i)
            i = parent[i]
        return out[::-1]

    inner = set(parent.values())
    want = {}
    for leaf in (i for i in parent if i not in inner and not i.startswith("c")):
        p = path(leaf)
        key = (-sum(score[x] for x in p) / len(p), -len(p), leaf)
        want.setdefault(p[0], []).append((key, p))
    for n in (1, 3):
        got = {tuple(x for _, x in t) for _, t, _ in back(chat.format_conversations(m, n))}
        assert got == {tuple(p) for ps in want.values() for _, p in sorted(ps, key=lambda x: (round(x[0][0], 9), *x[0][1:]))[:n]}


def test_language_model(spark):
    rnd = random.Random(9)
    left, right = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    texts = []
    for _ in range(400):
        t = []
        for k in range(rnd.randint(0, 30)):
            t.append(rnd.choice((left, right)[k % 2]) if rnd.random() < 0.9 else f"Rare{rnd.randrange(400)}")
        texts.append(" ".join(t))
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (7, texts[7]), (None, texts[3]), (None, None)]
    got = brown.score(docs(spark, rows), words=40, classes=6).collect()
    assert len(got) == len(rows)
    c = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update([*(t or "").lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*(t or "").lower().split(), None]
        want[(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert brown.score(docs(spark, [])).count() == 0
    lone = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    assert brown.score(docs(spark, [(lone, "never seen")])).collect()[0]["n_known"] == 0


def test_language_model_is_a_distribution(spark):
    texts = spark.createDataFrame([(t,) for t in ["a b c a b d", "b a c", "x a y b", "q"] * 5 + ["once only"]], "_t string")
    m = brown.fit(texts, words=4, classes=3, slots=8)
    assert np.allclose((10 ** m.transitions).sum(1), 1)
    counts = {bytes(r["word"]): r["n"] for r in m.vocabulary.collect()}
    ids, _, _, _ = brown._numbered([sorted(counts)], m.number.value, m.slots)
    mass, once = np.zeros(3), np.zeros(3)
    for i, w in zip(ids, sorted(counts)):
        mass[m.classes[i]] += counts[w]
        once[m.classes[i]] += counts[w] == 1
    mass[0] += m.counts[0]
    assert np.allclose(mass, m.sizes) and np.allclose(once, m.once) and mass.sum() == m.tokens and once[0] == 0
    with pytest.raises(ValueError):
        brown.fit(texts, classes=128)


def test_language_model_scores_match_brute_force(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["the", "of", "a"] if k % 2 else [f"w{rnd.randrange(60)}", "The", "River"]) for k in range(rnd.randrange(0, 40)))) for i in range(60)]
    rows += [(70, None), (71, "unseen1 unseen2 the"), (9, "unseen3 w1")]  # 9 and 71 are held out with others
    args = {"words": 6, "classes": 5, "slots": 16}
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    m = brown.fit(spark.createDataFrame([(t,) for t in train], "_t string"), **args)
    c = Counter(w for t in train for w in t.lower().split())
    frequent = [b""] + [w.encode() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5]]
    assert [w for w, _ in sorted(m.number.value.items(), key=lambda x: x[1])] == frequent

    def cls(w):  # None is the end
        i = m.number.value.get((w or "").encode())
        return int(m.classes[len(frequent) + xxhash.xxh64_intdigest(w.encode()) % 16] if i is None else m.classes[i])

    trans = np.zeros((5, 5))
    for t in train:
        w = [None, *t.lower().split(), None]
        for a, b in zip(w, w[1:]):
            trans[cls(a), cls(b)] += 1
    share = (trans.sum(0) + 0.01) / (trans.sum() + 0.05)
    size, once = trans.sum(0), np.zeros(5)
    for w, n in c.items():
        once[cls(w)] += n == 1
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in brown.score(docs(spark, rows), **args).collect())
    want = Counter()
    for i, t in rows:
        w, total = [None, *(t or "").lower().split(), None], 0.0
        for a, b in zip(w, w[1:]):
            x, y = cls(a), cls(b)
            total += math.log10((trans[x, y] + brown.SMOOTH * share[y]) / (trans[x].sum() + brown.SMOOTH))
            total += 0.0 if b is None else math.log10((c[b] if c[b] else once[y] + 1) / (size[y] + once[y] + 1))
        want[(i, round(total, 6))] += 1
    assert got == want


PAGES = [
    ("<body><nav><p>menu</p></nav><article><h1>A &amp; B</h1><p>one\n two<p>three &lt;x&gt;<br>four</article><footer>f</footer>", "A & B\none two\nthree <x> four"),
    ("<body><div class='top-menu'>m</div><div class=post-17><p>text of it<div class='ad-1'>buy</div><p>more</div><div id=comments><p>c</div>", "text of it\nmore"),
    ("<body><article><p>cut off <b>here", "cut off here"), (None, ""), ("", ""), ("plain &copy; text", "plain © text"), ("<script>var a='</p>';</script><style>p{}</style>", ""),
    ("<body><main><header><h1>T</h1></header><form><p>no</p></form><ul><li>1<li>2</ul><!-- <p>x --></main><aside>s</aside>", "T\n1\n2"), ("<article>a<p <b", "a"), ("<p>" * 3000 + "deep", "deep"),
]


def test_main_text(spark):
    rows = [(i, f"http://h{i}.com/", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(0, "http://h0.com/", PAGES[0][0], "clash"), (None, None, PAGES[0][0], "clash")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = Counter((r["page_id"], r["text"]) for r in html_text.extract(p).collect())
    assert got == Counter([(i, t) for i, (_, t) in enumerate(PAGES)] + [(0, PAGES[0][1]), (None, PAGES[0][1])])
    assert html_text.extract(p.limit(0)).count() == 0


def test_hosts_vote_for_one_path(spark):
    usual = "<body><div class='box1'><p>{}</p></div><div class='body2'><p>{}</p></div>"
    rows = [(i, "http://a.com/x", usual.format("word", "many words here " * 30)) for i in range(5)] + [(9, "http://a.com/y", usual.format("a long box, longer than the rest " * 20, "short"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short"


def test_licences_where_notices_are_frequent(spark):
    rnd = random.Random(11)
    filler = [" ".join(rnd.choice("river stone house green walks quiet old the of a".split()) for _ in range(10)) for _ in range(150)]
    notices = [f"This project {n} is MIT licensed." for n in filler[:60]] + [f"Licensed to the Apache Software Foundation (ASF) under contributor license agreements {n}" for n in filler[60:120]]
    rows = list(enumerate(filler + notices)) + [(1000 + i, f"{filler[i]} Released under the MIT License. {filler[i + 1]}") for i in range(40)]
    rows += [(2000, "Released under the MIT License. Licensed under the Apache License, Version 2.0."), (2001, "Licensed under CC BY-SA 4.0."), (2002, "SPDX-License-Identifier: MPL-2.0")]
    train, held = licences._samples(licences.paragraphs(docs(spark, rows), "doc_id", "text"), 1500)
    sampled = {r["line"] for r in train.union(held).collect()}
    assert sampled == set(filler)  # all others, and no notice in any wording
    got = {(r["doc_id"], r["family"]) for r in licences.scan(docs(spark, rows)).where("confirmed").collect() if r["doc_id"] >= 1000}
    assert got == {*((1000 + i, "MIT") for i in range(40)), (2000, "MIT"), (2000, "Apache-2.0"), (2001, "CC-BY-SA"), (2002, "MPL")}


def test_licences(spark):
    rnd = random.Random(10)
    filler = [" ".join(rnd.choice("river stone house under green version walks the of a mit".split()) for _ in range(12)) for _ in range(400)]
    rows = [(i, f) for i, f in enumerate(filler)]
    rows += [(1000, filler[0] + "\nReleased under the MIT License.\n" + filler[1]), (1001, "Licensed under CC BY-NC 4.0."), (1002, "This work is licensed under the GNU General Public License, version 2."),
             (1003, "\n\nLicensed under the Apache License, Version 2.0.\n\n"), (1003, "\n\nLicensed under the Apache License, Version 2.0.\n\n"), (1004, "He lost his driving license under the old version."), (1005, None), (1006, ""), (None, "Released under the MIT License.")]
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in licences.scan(docs(spark, rows)).where("confirmed").collect()}
    assert got == {(1000, 1, "MIT"), (1001, 0, "CC-BY-NC"), (1002, 0, "GPL"), (1003, 2, "Apache-2.0"), (None, 0, "MIT")}
    assert licences.scan(docs(spark, [])).count() == 0


def test_licences_learn_from_every_paragraph(spark):
    lines = [f"River {i} walks past the quiet stone house" for i in range(9000)] + [f"The apache of house {i} walks" for i in range(30)]
    lines += ["Released under the MIT License.", "copyright someone", "the river is relicensed to gnu"]  # these name a licence
    rows = docs(spark, [(i, "\n".join(lines[i::50]) + "\n" + lines[0]) for i in range(50)])
    n = Counter()
    for r in licences._feature_sets(spark, licences.paragraphs(rows, "doc_id", "text"), ["apache", "mit"]).collect():
        n[r["use"]] += r["n"]
        n[r["use"], tuple(r["features"])] += r["n"]
    assert n[0, ()] + n[2, ()] == 9000 and n[0, ("apache",)] + n[2, ("apache",)] == 30 and n[0] + n[2] == 9030
    assert n[1] == n[0] > 4000 and n[2] > 4000


def test_bpe_memo_keeps_what_is_in_use(monkeypatch):
    from helixloom.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = bpe.Encoder(path)
    texts = [b"the cat, the dog 7th \xc3\xa9t\xc3\xa9 " + b" ".join(b"w%s" % bytes([97 + i % 26, 97 + i // 26, c]) for c in b"xyz") for i in range(60)]
    want = [plain.ids(t) for t in texts]
    monkeypatch.setattr(bpe, "MEMO", 16)
    enc, asked = bpe.Encoder(path), []
    known = enc._plain_entry
    enc._plain_entry = lambda w: asked.append(w) or known(w)
    assert [[i for p in enc.pieces(t) for i in p[0]] for t in texts] == want
    assert asked.count("the") == 1  # clearing the whole memo forgets it each time
    assert len(enc.memo) <= 16 + 10 and len(enc.words) <= 16
