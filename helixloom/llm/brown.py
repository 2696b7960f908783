"""Language-model scores from Brown classes.

Exchange clustering moves words between classes so that the class bigram likelihood of the corpus grows. The ``WORDS`` most frequent words
are exchanged one by one on the counts of their adjacent pairs, until the likelihood stops growing. All other words have a class too: they
share ``SLOTS`` slots by hash, and a slot takes the class that explains its words' neighbours best. So every token has a class that a task can
look up in a table of fixed size, every token is history of the next, and transitions are counted over all adjacent tokens.

A token's probability is P(class | class before) * P(word | class). Transitions are smoothed towards the class unigram; a class gives a word
unseen in training the mass of its words seen once. Counts cover all training texts and are summed before they are shuffled. Only tables
bounded by the parameters (WORDS words, SLOTS classes, CLASSES squared counts) pass the driver. The counts of the other words meet their
tokens in an equi-join; only sums go back to the text.
"""

from __future__ import annotations

import struct
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_words, write_table

WORDS = 1 << 14
SLOTS = 1 << 20
CLASSES = 64  # at most 127
GROWTH = 1e-3  # rounds end when the mutual information of adjacent classes grows by less than this part of it
SMOOTH = 2.0
FLUSH = 1 << 17  # distinct words a task counts before it sends them on
CODES = 1 << 20  # the same for numbers
OWN = "<qbqqdd"  # doc_id, flags, tokens, known, base, score of what the text needs no join for
END = 0  # number of the text's end, and of what stands before its first word


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 7, is 2. A null id is in the training fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _texts(batch):
    """The words of the texts of a batch, few texts at a time in memory."""
    column = batch.column("_t").cast(pa.binary())
    for lo in range(0, len(column), 64):
        for x in column.slice(lo, 64).to_pylist():
            yield (x or b"").lower().split()


def _counted(rows: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.binary()), pa.array(rows.values(), pa.int64())], ["word", "n"])


def _count_words(batches):
    seen: Counter = Counter()
    for b in batches:
        for words in _texts(b):
            seen.update(words)
            if len(seen) > FLUSH:
                yield _counted(seen)
                seen.clear()
    if seen:
        yield _counted(seen)


def _numbered(texts: list[list[bytes]], number: dict[bytes, int], slots: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """For the tokens of some texts, ends included: number, the number before, the words, the text's index. Frequent words have numbers of
    their own, the others len(number) and their slot."""
    words: list[bytes] = []
    sizes = []
    for t in texts:
        words.append(b"")
        words += t
        sizes.append(len(t) + 1)
    words.append(b"")
    ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))  # the empty word is END
    rare = np.flatnonzero(ids < 0)
    if len(rare):
        ids[rare] = len(number) + (hash_words([words[i] for i in rare.tolist()]) & np.uint64(slots - 1)).astype(np.int64)
    return ids[1:], ids[:-1], words[1:], np.repeat(np.arange(len(texts)), sizes)


def _slices(batch, most: int = 1 << 18):
    """Texts of a batch, some at a time, as (first index, texts)."""
    part, first, size = [], 0, 0
    for i, t in enumerate(_texts(batch)):
        part.append(t)
        size += len(t) + 1
        if size >= most:
            yield first, part
            part, first, size = [], i + 1, 0
    if part:
        yield first, part


def _number_texts(number, slots):
    """The numbers of some texts on end, each text with its end, after one end."""

    def run(batches):
        for b in batches:
            for _, texts in _slices(b, 1 << 15):
                ids, _, _, _ = _numbered(texts, number.value, slots)
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[END], ids]).astype(np.int32).tobytes()], pa.binary())], ["ids"])

    return run


def _sequences(batches):
    for b in batches:
        column = b.column("ids")
        for i in range(len(column)):
            yield np.frombuffer(column[i].as_buffer(), np.int32).astype(np.int64)


def _count_codes(codes_of):
    """(code, n) of the numbers that ``codes_of`` makes of a sequence."""

    def out(codes):
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

    def run(batches):
        codes, size = [], 0
        for ids in _sequences(batches):
            codes.append(codes_of(ids[:-1], ids[1:]))
            size += len(codes[-1])
            if size > CODES:
                yield out(codes)
                codes, size = [], 0
        if codes:
            yield out(codes)

    return run


def _pairs_of(n_words):
    """Adjacent frequent words."""

    def run(before, ids):
        keep = (ids < n_words) & (before < n_words)
        return before[keep] << 32 | ids[keep]

    return run


def _neighbours_of(n_words, classes):
    """Slots with the classes of the frequent words next to them: slot, side (0 before), class."""

    def run(before, ids):
        after = (ids >= n_words) & (before < n_words)
        ahead = (ids < n_words) & (before >= n_words)
        return np.concatenate([(ids[after] - n_words) << 8 | classes[before[after]], (before[ahead] - n_words) << 8 | 128 | classes[ids[ahead]]])

    return run


def exchange(pairs: DataFrame, n_words: int, classes: int = CLASSES, growth: float = GROWTH) -> tuple[np.ndarray, np.ndarray]:
    """Class of each numbered word from pair counts (before, word, n), and the counts of adjacent classes; class 0 is END's alone.

    The start has the most frequent words in classes of their own and all others in the last. Each round sums the pairs to (word, class)
    tables on the executors, then moves words to their classes of greatest gain: all in the first round, one half in turn after it. The rounds
    end when the likelihood has grown too little twice; the best classes stay.
    """
    cls = np.minimum(np.arange(n_words), classes - 1).astype(np.int64)
    spark = pairs.sparkSession
    best_value, best_cls, best_trans, r, idle = -np.inf, cls, np.zeros((classes, classes)), 0, 0
    while True:
        shared = spark.sparkContext.broadcast(cls.astype(np.int32))

        def fold(batches, shared=shared):
            cl = shared.value
            tables, size, held = np.zeros((2, n_words * classes), np.int64), 0, []

            def add():
                x, w, n = (np.concatenate(c) for c in zip(*held))
                tables[0] += np.bincount(x * classes + cl[w], n, n_words * classes).astype(np.int64)
                tables[1] += np.bincount(w * classes + cl[x], n, n_words * classes).astype(np.int64)

            for b in batches:
                held.append(tuple(b.column(c).to_numpy() for c in ("before", "word", "n")))
                size += b.num_rows
                if size > CODES:
                    add()
                    size, held = 0, []
            if held:
                add()
            for side in (0, 1):
                at = np.flatnonzero(tables[side])
                for lo in range(0, len(at), 1 << 16):
                    part = at[lo:lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), side, np.int32)), pa.array((part // classes).astype(np.int32)), pa.array((part % classes).astype(np.int32)), pa.array(tables[side][part])], ["side", "i", "c", "n"])

        folded = pairs.mapInArrow(fold, "side int, i int, c int, n long").groupBy("side", "i", "c").agg(F.sum("n").alias("n"))
        rows = folded.toArrow()  # at most 2 * WORDS * CLASSES rows of four numbers
        t = np.zeros((2, n_words, classes))
        t[tuple(rows[c].to_numpy() for c in ("side", "i", "c"))] = rows["n"].to_numpy()
        del rows
        shared.unpersist()
        after, before = t
        trans = np.zeros((classes, classes))
        np.add.at(trans, cls, after)  # trans[a, b]: class a before class b
        value = _information(trans)
        idle = 0 if value > best_value + growth * abs(best_value) else idle + 1
        if value > best_value:
            best_value, best_cls, best_trans = value, cls, trans
        if idle == 2:
            return best_cls, best_trans
        lp = np.log((trans + 0.1) / (trans.sum(1, keepdims=True) + 0.1 * classes))
        gain = before @ lp + after @ lp.T - before.sum(1, keepdims=True) * np.log(trans.sum(0) + 1.0)[None, :]
        gain[:, 0] = -np.inf
        to = gain.argmax(1)
        if r > 0:
            stay = np.arange(n_words) % 2 == r % 2
            to[stay] = cls[stay]
        to[END] = 0
        cls, r = to, r + 1


def _information(trans: np.ndarray) -> float:
    """Mutual information of adjacent classes: the part of the corpus likelihood that depends on the classes."""
    total = trans.sum()
    if not total:
        return 0.0
    a, b = np.nonzero(trans)
    return float((trans[a, b] * np.log(trans[a, b] * total / (trans.sum(1)[a] * trans.sum(0)[b]))).sum() / total)


@dataclass
class Model:
    number: object  # broadcast: frequent word -> number
    classes: np.ndarray  # of the frequent words, then of the slots
    counts: np.ndarray  # of the frequent words
    vocabulary: DataFrame  # word, n
    transitions: np.ndarray  # log10 P(class | class before)
    sizes: np.ndarray  # training tokens of each class
    once: np.ndarray  # its words seen once
    tokens: int
    types: int

    @property
    def slots(self) -> int:
        return len(self.classes) - len(self.counts)

    @property
    def mass(self) -> np.ndarray:
        """What the words of a class and its unseen words share; a text's end has no unseen kind."""
        m = self.sizes + self.once + 1
        m[0] = max(self.sizes[0], 1)
        return m


def _slot_classes(lp: np.ndarray, sizes: np.ndarray):
    """(slot, contexts) to (slot, cls, n): the class of greatest likelihood of the neighbours."""

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), 4096):
                lists = f["ctx"].iloc[lo:lo + 4096].tolist()
                lens = np.array([len(x) for x in lists])
                k = np.array([e["k"] for x in lists for e in x])
                n = np.array([e["n"] for x in lists for e in x], float)
                part = np.where((k < 128)[:, None], lp[k & 127] - np.log(sizes + 1.0), lp.T[k & 127]) * n[:, None]
                gain = np.add.reduceat(part, np.concatenate(([0], np.cumsum(lens)[:-1])), axis=0)
                gain[:, 0] = -np.inf
                yield pd.DataFrame({"slot": f["slot"].iloc[lo:lo + 4096].astype("int32"), "cls": gain.argmax(1).astype(np.int32), "n": np.add.reduceat(n, np.concatenate(([0], np.cumsum(lens)[:-1]))).astype(np.int64)})

    return run


def fit(train: DataFrame, words: int = WORDS, classes: int = CLASSES, slots: int = SLOTS, growth: float = GROWTH) -> Model:
    """``train`` has the texts as _t. ``slots`` is a power of two; it bounds the table of classes, not the words that have one."""
    if not 2 <= classes <= 127:
        raise ValueError("between 2 and 127 classes")
    sc = train.sparkSession.sparkContext
    vocabulary = write_table(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    ends = train.count()
    sums = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, types = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    top = vocabulary.orderBy(F.desc("n"), "word").limit(words - 1).collect()
    number = sc.broadcast({b"": END, **{bytes(r["word"]): i + 1 for i, r in enumerate(top)}})
    n_words = len(top) + 1
    counts = np.array([ends, *[r["n"] for r in top]], float)

    # the texts as numbers, once: later passes don't take words apart again
    numbers = write_table(train.mapInArrow(_number_texts(number, slots), "ids binary"))

    def counted(codes_of):
        return numbers.mapInArrow(_count_codes(codes_of), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))

    pairs = counted(_pairs_of(n_words))
    pairs = write_table(pairs.select(F.shiftright("code", 32).cast("int").alias("before"), F.col("code").bitwiseAND((1 << 32) - 1).cast("int").alias("word"), "n"))
    # every task of a round sends its own (word, class) sums: no more tasks than the pairs fill
    pairs = pairs.coalesce(max(1, pairs.count() // CODES + 1))
    cls, trans = exchange(pairs, n_words, classes, growth) if top else (np.zeros(1, np.int64), np.zeros((classes, classes)))
    lp = np.log((trans + 0.1) / (trans.sum(1, keepdims=True) + 0.1 * classes))
    near = counted(_neighbours_of(n_words, cls)).select(F.shiftright("code", 8).cast("int").alias("slot"), F.struct(F.col("code").bitwiseAND(255).cast("int").alias("k"), "n").alias("e"))
    found = near.groupBy("slot").agg(F.collect_list("e").alias("ctx")).mapInPandas(_slot_classes(lp, trans.sum(0)), "slot int, cls int, n long").toArrow()  # at most SLOTS rows
    slot, slot_cls, n = (found[c].to_numpy() for c in ("slot", "cls", "n"))
    usual = int(np.bincount(slot_cls, n, classes)[1:].argmax()) + 1  # for slots without a frequent neighbour
    table = np.full(n_words + slots, usual, np.int8)
    table[:n_words] = cls
    table[n_words + slot] = slot_cls
    shared = sc.broadcast(table)

    def transitions_of(batches):
        t = np.zeros(classes * classes, np.int64)
        for ids in _sequences(batches):
            c = shared.value[ids].astype(np.int64)
            t += np.bincount(c[:-1] * classes + c[1:], minlength=classes * classes)
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(t[at])], ["code", "n"])

    def once_of(batches):
        t = np.zeros(classes, np.int64)
        for b in batches:
            w = b.column("word").to_pylist()
            if w:
                ids, _, _, _ = _numbered([w], number.value, slots)
                t += np.bincount(shared.value[ids[:-1]], minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(t)], ["code", "n"])

    def summed(d):
        return {r["code"]: r["n"] for r in d.groupBy("code").agg(F.sum("n").alias("n")).collect()}  # CLASSES squared rows at most

    trans = np.zeros(classes * classes)
    for k, v in summed(numbers.mapInArrow(transitions_of, "code long, n long")).items():
        trans[k] = v
    trans = trans.reshape(classes, classes)
    once = np.zeros(classes)
    for k, v in summed(vocabulary.where("n = 1").select("word").mapInArrow(once_of, "code long, n long")).items():
        once[k] = v
    share = (trans.sum(0) + 0.01) / (trans.sum() + 0.01 * classes)
    logs = np.log10((trans + SMOOTH * share[None, :]) / (trans.sum(1, keepdims=True) + SMOOTH))
    return Model(number, table, counts, vocabulary, logs, trans.sum(0), once, int(tokens), int(types))


def _score_texts(m: Model, denominator: int):
    """Rows to join: words that aren't frequent (word, row, class) and one row for each text with the sums that need no join, under a word of
    its own that no table holds."""
    number, counts, slots, n_words = m.number, m.counts, m.slots, len(m.counts)
    shared = m.vocabulary.sparkSession.sparkContext.broadcast(m.classes)
    logs, rest = m.transitions, -np.log10(m.mass)
    emit, base, known = np.log10(np.maximum(counts, 1e-9)), np.log10((counts + 1) / denominator), counts > 0

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            ids_col, held = b.column("doc_id").to_pylist(), b.column("held_out").to_pylist()
            for first, texts in _slices(b):
                ids, before, words, text = _numbered(texts, number.value, slots)
                cls = shared.value[ids].astype(np.int64)
                n = len(texts)
                value = logs[shared.value[before], cls] + rest[cls]
                f = np.flatnonzero(ids < n_words)
                value[f] += emit[ids[f]]
                score = np.bincount(text, value, n)
                plain = np.bincount(text[f], base[ids[f]], n)
                seen = np.bincount(text[f], known[ids[f]], n)
                total = np.bincount(text, minlength=n)
                own = [struct.pack(OWN, ids_col[first + i] or 0, (ids_col[first + i] is None) + 2 * held[first + i], int(total[i]), int(seen[i]), plain[i], score[i]) for i in range(n)]
                rare = np.flatnonzero(ids >= n_words)
                names = [b"\x20" + (row + i).to_bytes(8, "big") for i in range(n)]  # words have no space
                yield pa.RecordBatch.from_arrays([
                    pa.array(names + [words[i] for i in rare.tolist()], pa.binary()), pa.array(np.concatenate([row + np.arange(n), row + text[rare]]), pa.int64()),
                    pa.array(np.concatenate([np.zeros(n, np.int64), cls[rare]]).astype(np.int8)), pa.array(own + [None] * len(rare), pa.binary())], ["word", "row", "cls", "own"])
                row += n

    return run


def _unpack(frames):
    for f in frames:
        own = np.array([struct.unpack(OWN, x) for x in f["own"]], dtype=object).reshape(-1, 6)
        yield pd.DataFrame({
            "doc_id": pd.array([None if x[1] & 1 else x[0] for x in own], "Int64"), "held_out": [bool(x[1] & 2) for x in own], "n_tokens": own[:, 2].astype("int64"),
            "n_known": own[:, 3].astype("int64") + f["known"].to_numpy("int64"), "base_score": own[:, 4].astype(float) + f["base"], "score": own[:, 5].astype(float) + f["score"]})


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input row; scores are sums of log10.

    Null and empty texts are their end alone. Repeated rows and null ids come out as often as they come in. Without training texts every
    token is unknown.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    m = fit(d.where("NOT held_out").select("_t"), **params)
    denominator = m.tokens + m.types + 1
    rows = d.mapInArrow(_score_texts(m, denominator), "word binary, row long, cls byte, own binary")
    # a partition's share of the vocabulary is looked up, so that the tokens need no sorting
    joined = rows.join(m.vocabulary.withColumnRenamed("n", "c").hint("shuffle_hash"), "word", "left")
    unseen = F.element_at(F.array(*[F.lit(float(np.log10(x + 1))) for x in m.once]), F.col("cls").cast("int") + 1)
    token = F.col("own").isNull()
    sums = joined.groupBy("row").agg(
        F.max("own").alias("own"), F.sum(F.when(token & F.col("c").isNotNull(), 1).otherwise(0)).alias("known"),
        F.sum(F.when(token, F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(denominator)))).otherwise(0.0)).alias("base"),
        F.sum(F.when(token, F.coalesce(F.log10("c"), unseen)).otherwise(0.0)).alias("score"))
    out = sums.select("own", "known", "base", "score").mapInPandas(_unpack, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"), "base_score", "score")
