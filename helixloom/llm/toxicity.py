"""Toxicity by weak supervision.

Voters are lexicon words and patterns (word beginnings, several different hits, shouting, dense hits). A generative model of the votes, with
the training labels as one more, noisy, voter, estimates by EM how often each voter fires on toxic and on clean texts; voters that
still move together inside a class are correlated and share one vote between them. A logistic regression is trained on the
posterior labels; it alone scores texts. Labels come only from the training fold.

Bound: voters are mined and models fitted on at most ``SAMPLE`` labelled training rows, the first by the hash of their id.
Everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import ascii_lower, text_of, words_of, words_of_text

SAMPLE = 20_000
WORD_VOTERS = 512
PREFIX_VOTERS = 128
PREFIX = 5
MIN_Z = 6.0
# fixed values: insults that vote in any case
LEXICON = ["bastard", "clown", "disgusting", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
EDGE = b".,;:!?\"'()[]{}*#$%&<>|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
PATTERNS = ["two different hits", "four different hits", "dense hits", "shouting"]


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def capitals(text: str) -> int:
    if text.isascii():
        raw = text.encode()
        return len(raw) - len(raw.translate(None, CAPITALS))
    return sum(map(str.isupper, text))


@dataclass
class Model:
    words: list[str]
    prefixes: list[str]
    weights: np.ndarray = None
    accuracy: np.ndarray = None  # of each voter and, last, of the labels: P(fires | clean), P(fires | toxic)
    shares: np.ndarray = None
    index: dict = field(default_factory=dict)

    def __post_init__(self):
        self.by_word = {w.encode(): i for i, w in enumerate(self.words)}
        self.by_prefix = {p.encode(): len(self.words) + i for i, p in enumerate(self.prefixes)}
        self.n_lexical = len(self.words) + len(self.prefixes)
        self.n_voters = self.n_lexical + len(PATTERNS)

    def voters_of(self, word: bytes) -> tuple[int, ...]:
        """Voters that a raw lower-cased word makes fire; memo of bounded size."""
        found = self.index.get(word)
        if found is None:
            if len(self.index) > 1 << 17:
                self.index.clear()
            bare = word.strip(EDGE)
            head = bare.decode("utf-8", "replace")[:PREFIX].encode()
            found = tuple(i for i in (self.by_word.get(bare), self.by_prefix.get(head)) if i is not None)
            self.index[word] = found
        return found

    def votes(self, text: str | None) -> tuple[list[int], float, float]:
        """Voters that fire, hits per hundred words, log of hits."""
        words = words_of_text(text)
        hits = [v for v in map(self.voters_of, words) if v]
        fired = {i for v in hits for i in v}
        kinds, density = len({v[0] for v in hits}), 100 * len(hits) / max(1, len(words))
        # shouting is a pattern over the raw text: half of all its characters are capitals
        on = [kinds >= 2, kinds >= 4, density >= 1, bool(text) and 2 * capitals(text) >= len(text)]
        return sorted(fired) + [self.n_lexical + k for k, x in enumerate(on) if x], min(density, 20) / 5, float(np.log1p(len(hits)))

    def features(self, texts) -> np.ndarray:
        x = np.zeros((len(texts), self.n_voters + 3))
        x[:, -1] = 1
        for r, t in enumerate(texts):
            fired, density, log_hits = self.votes(t)
            x[r, fired] = 1
            x[r, -3:-1] = density, log_hits
        return x

    def score(self, text: str | None) -> float:
        fired, density, log_hits = self.votes(text)
        w = self.weights
        z = w[-1] + w[-3] * density + w[-2] * log_hits + sum(w[i] for i in fired)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def __getstate__(self):
        return {**self.__dict__, "index": {}}


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM of a two-class generative model. Returns P(fires | class) of the voters and last of the label, posterior toxicity of each row, and
    each voter's share: one over one plus the correlations it has with other voters within the classes."""
    v = np.column_stack([votes, labels]).astype(float)
    post = np.clip(labels.astype(float), 0.05, 0.95)
    share = np.ones(v.shape[1])
    for r in range(rounds):
        w = np.stack([1 - post, post])
        p = (w @ v + np.array([[0.1], [0.1]])) / (w.sum(1, keepdims=True) + 1.0)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        if r % 5 == 4 or r == 0:
            corr = np.zeros((v.shape[1],) * 2)
            for c in (0, 1):  # correlation left inside a class
                mean, weight = p[c], w[c]
                cov = (v * weight[:, None]).T @ v / max(weight.sum(), 1) - np.outer(mean, mean)
                sd = np.sqrt(mean * (1 - mean))
                corr = np.maximum(corr, np.clip(cov / np.outer(sd, sd), 0, 1) * (weight.sum() > 20))
            np.fill_diagonal(corr, 0)
            corr[-1, :] = corr[:, -1] = 0
            share = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(1))
        prior = np.clip(w.sum(1) / w.sum(), 1e-4, 1)
        on, off = np.log(p[1] / p[0]) * share, np.log((1 - p[1]) / (1 - p[0])) * share
        z = np.log(prior[1] / prior[0]) + v @ on + (1 - v) @ off
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p.T, post, share


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps on soft labels; the last column is the intercept."""
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(reg)
        step = np.linalg.solve(h, x.T @ (y - p) - reg * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _mined(rows: DataFrame, feature: Column, top: int) -> list[str]:
    """Features of ``rows`` (_w, toxic) that toxic texts have far more often than chance gives them."""
    n = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not n["n"] or not n["t"]:
        return []
    pi = n["t"] / n["n"]
    seen = rows.select("toxic", F.explode(F.array_distinct(feature)).alias("f")).where("f <> ''").groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("c"))
    z = (F.col("a") - F.col("c") * pi) / F.sqrt(F.col("c") * pi * (1 - pi) + 1e-9)
    best = seen.where((F.col("a") >= 4) & (2 * F.col("a") >= F.col("c")) & (z >= MIN_Z)).orderBy(z.desc(), "f").limit(top)
    return [r["f"] for r in best.collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Voters, label model and classifier from the training fold of ``labels`` (doc_id, toxic).

    Null labels and ids are left out; several labels of one id count by their majority, ties as toxic. Equal texts count once. Without
    any label, or with labels of one class, the fixed lexicon alone votes.
    """
    y = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").alias("_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    y = y.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(F.col(f"`{text}`")).alias("_t"))
    train = d.join(F.broadcast(y), "_id")  # at most ``sample`` rows of two numbers
    train = train.groupBy(F.md5("_t").alias("_k")).agg(F.first("_t").alias("_t"), F.max("toxic").alias("toxic"))
    train = train.select("_t", "toxic").persist()
    strip = r"^[.,;:!?\"'()\[\]{}*#$%&<>|]+|[.,;:!?\"'()\[\]{}*#$%&<>|]+$"
    bare = train.select("toxic", F.transform(words_of(ascii_lower(F.col("_t"))), lambda w: F.regexp_replace(w, strip, "")).alias("_w"))
    words = _mined(bare, F.col("_w"), WORD_VOTERS)
    heads = F.transform(F.filter("_w", lambda w: F.char_length(w) > PREFIX), lambda w: F.substring(w, 1, PREFIX))
    prefixes = _mined(bare, heads, PREFIX_VOTERS)
    model = Model(sorted({*LEXICON, *words}), sorted(prefixes))

    def vote(frames):
        for f in frames:
            for t, y in zip(f["_t"], f["toxic"]):
                fired, density, log_hits = model.votes(t)
                yield pd.DataFrame({"fired": [fired], "density": [density], "log_hits": [log_hits], "toxic": [int(y)]})

    rows = train.mapInPandas(vote, "fired array<int>, density double, log_hits double, toxic int").collect()  # at most ``sample`` short rows
    train.unpersist()
    x, labelled = np.zeros((len(rows), model.n_voters + 3)), np.array([r["toxic"] for r in rows], float)
    for i, r in enumerate(rows):
        x[i, r["fired"]] = 1
        x[i, -3:] = r["density"], r["log_hits"], 1
    if len(rows) and 0 < labelled.sum() < len(rows):
        model.accuracy, post, model.shares = label_model(x[:, :model.n_voters], labelled)
        model.weights = logistic(x, post)
    else:
        model.weights = np.concatenate([np.full(model.n_lexical, 2.5), np.full(len(PATTERNS) - 1, 0.5), [0.0], [0.5, 0.5, -3.0]])
    return model


def scorer(model: Model):
    """Text column -> probability of being toxic. Null and empty texts get the score of a text without votes."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for every input row; only the text enters a score."""
    s = scorer(fit(docs, labels, id_col, text))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), s(F.col(f"`{text}`")).alias("score"))
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with the columns they came with."""
    named = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    s = scorer(fit(named, labels, at["doc_id"], at["text"]))
    return named.where(s(F.col(at["text"])) < 0.5).select(*[F.col(v).alias(c) for c, v in at.items()])
