"""Toxicity by maximum-scoring segments over token log-odds.

Learning. At most ``FIT_ROWS`` labelled rows are learned from. Each gives the set of its words and of their prefixes;
documents with and without the label are counted for each. A word's rate has
its prefix's rate as Dirichlet prior, a prefix the shorter prefix's, that one
the base rate; a rate against the base rate is a log-odds score, below zero
where a word speaks against the label. A word that was not learned has its
longest learned prefix's score. A feature is learned if enough documents hold
it: ``LEAST_DOCUMENTS``, or the number of all (feature, document) pairs over
``LEXICON`` if that is more. So no more than ``LEXICON`` features can be, and
the lexicon, the one part of the model that is sent to workers, has that bound.

Scoring. A text is scanned once; each token adds its score less ``DRIFT``, so
ordinary text drifts down. Ruzzo and Tompa's scan yields all maximal segments
in linear time. Extreme values are calibrated on the learning rows without the
label: Karlin and Altschul's lambda from their token scores, K as the most
likely value given the best segment of each. A segment of score S in a text of
n tokens has expectation K n exp(-lambda S).
Segments expected less than ``ALPHA`` times are significant; a document's
evidence is the log expectation of all its significant segments, or of its best
one. A logistic curve through binned counts of the learning rows makes it a
probability.

Defined results: a null or empty text has no segment and the lowest score; a
null doc_id is neither learned from nor held out (false); rows without a label
are scored alike; repeated rows each get their row; without learning rows all
scores are the same; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, settle, texts_of, train_fold

#: Labelled rows that are learned from at most: those with the least hashes of their ids.
FIT_ROWS = 50_000
LEXICON = 400_000
PREFIXES = (5, 4)
PRIOR = 10.0
LEAST_DOCUMENTS = 3
DRIFT = 0.7
ALPHA = 0.01
BIN = 0.25

_words = re.compile(r"[^\W_]+").findall


def tokens(text: str) -> list[str]:
    return _words(text.lower())


def prefix_keys(word: str) -> list[str]:
    """Prefix features of a word, the longest first."""
    return [f"{word[:k]}*" for k in PREFIXES if len(word) > k]


@dataclass
class Model:
    base: float = 0.1
    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = 0.0

    def score(self, word: str) -> float:
        found = self.scores.get(word)
        if found is None:
            for p in prefix_keys(word):
                found = self.scores.get(p)
                if found is not None:
                    return found
            return 0.0
        return found


def maximal_segments(values: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text whose tokens score -drift but for (position, value).

    Each held segment is linked to the nearest one before it that begins lower:
    the search goes by these links, which makes the scan linear.
    """
    # each held segment: first, last, sum before it, sum up to its end, link
    held: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for pos, value in values:
        total -= drift * (pos - at)
        at = pos + 1
        low, total = total, total + value - drift
        if value <= drift:
            continue
        first, high = pos, total
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= low:
                j = held[j][4]
            if j < 0 or held[j][3] >= high:
                held.append((first, pos, low, high, j))
                break
            first, low, link = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = link
    return [(a, b, high - low) for a, b, low, high, _ in held]


def _values(model: Model, words: list[str]) -> list[tuple[int, float]]:
    """Positions and scores of the words that have one."""
    scores = {w: s for w in set(words) if (s := model.score(w))}
    return [(i, scores[w]) for i, w in enumerate(words) if w in scores] if scores else []


def best_segment(model: Model, text: str) -> tuple[int, float]:
    """Tokens of a text, and the score of its best segment (0 without one)."""
    words = tokens(text)
    return len(words), max((s for *_, s in maximal_segments(_values(model, words), DRIFT)), default=0.0)


def evidence(model: Model, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Evidence, token count and the significant segments (first token, last token, score) of a text."""
    words = tokens(text)
    values = _values(model, words)
    n = max(1, len(words))
    best, total, passages = -math.log(model.k * n + 1), 0.0, []
    edge = math.log(model.k * n / ALPHA)
    for a, b, s in maximal_segments(values, DRIFT):
        e = model.decay * s - math.log(model.k * n)
        best = max(best, e)
        if model.decay * s > edge:
            passages.append((a, b, s))
            total += max(0.0, e)
    return max(best, total), len(words), passages


def _counts(rows):
    """(feature, with, without): documents that hold each word or prefix, summed over what a task has read so far."""
    seen = (Counter(), Counter())

    def done():
        keys = list(seen[0].keys() | seen[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (seen[1], seen[0]))], names=["feature", "hit", "miss"])
        seen[0].clear()
        seen[1].clear()
        return out

    for b in rows:
        for text, label in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
            words = set(tokens(text))
            c = seen[label]
            c.update(words)
            c.update({p for w in words for p in prefix_keys(w)})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield done()
    yield done()


def _lexicon(counts: DataFrame, base: float) -> dict[str, float]:
    """Scores of the features that enough documents hold, ``LEXICON`` of them at most: collected by that bound."""
    odds = lambda r: math.log(r / (1 - r)) - math.log(base / (1 - base))
    held = F.col("hit") + F.col("miss")
    pairs = counts.agg(F.coalesce(F.sum(held), F.lit(0)).alias("n")).first()["n"]
    rows = {r["feature"]: (r["hit"], r["miss"]) for r in counts.where(held >= max(LEAST_DOCUMENTS, -(-pairs // LEXICON))).toLocalIterator()}
    rates: dict[str, float] = {}

    def rate(key: str) -> float:
        if key not in rates:
            if key.endswith("*"):
                above = [f"{key[:k]}*" for k in PREFIXES if len(key) - 1 > k]
            else:
                above = prefix_keys(key)
            prior = next((rate(p) for p in above if p in rows), base)
            hit, miss = rows[key]
            rates[key] = (hit + PRIOR * prior) / (hit + miss + PRIOR)
        return rates[key]

    return {k: odds(rate(k)) for k in rows}


def _decay(hist: dict[float, int]) -> float:
    """lambda > 0 with sum of p(s) exp(lambda s) = 1 over token scores s less the drift, found by halving."""
    total = sum(hist.values()) + 1
    steps = {s - DRIFT: n / total for s, n in hist.items()}
    if not any(s > 0 for s in steps):
        return 1.0
    f = lambda x: sum(p * math.exp(min(700.0, x * s)) for s, p in steps.items()) - 1
    low, high = 1e-3, 1.0
    while f(high) < 0:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(0.05, low)


def _logistic(bins: dict[tuple[float, int], int]) -> tuple[float, float]:
    """Slope and offset of the curve through binned counts (value, label); a little ridge keeps it finite."""
    x = np.array([k[0] for k in bins], float)
    y = np.array([k[1] for k in bins], float)
    w = np.array(list(bins.values()), float)
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-2 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learn from the rows of ``train_fold`` that have a 0 / 1 label."""
    known = labels.where(train_fold(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = first_by_hash(known, "doc_id", FIT_ROWS, known.count())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # at most FIT_ROWS pairs of numbers go to every worker, so no text is dealt
    rows = settle(documents.where(train_fold(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id").select("text", "label"), "toxic-rows")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    base = n[1] / (n[0] + n[1])
    counts = settle(rows.mapInArrow(_counts, "feature string, hit long, miss long").groupBy("feature").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss")), "toxic-features")
    model = Model(base, _lexicon(counts, base))

    def background(batches):
        hist = Counter()
        for b in batches:
            for t in texts_of(b.column(0)):
                words = tokens(t)
                found = [s for s in map(model.score, set(words)) if s]
                hist.update(math.ceil(s / BIN) * BIN for s in found)
                hist[0.0] += len(words) - len(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(hist), pa.float64()), pa.array(list(hist.values()), pa.int64())], names=["s", "n"])

    # token scores by bins of at most BIN and at most some thousand values, whatever the rows
    hist = {r["s"]: r["n"] for r in rows.where("label = 0").select("text").mapInArrow(background, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()}
    model.decay = _decay(hist)

    def tops(batches):
        """Texts whose best segment is above 0, and the sum of n exp(-lambda S) over all."""
        hits, weight = 0, 0.0
        for b in batches:
            for t in texts_of(b.column(0)):
                n, top = best_segment(model, t)
                hits += top > 0
                weight += max(1, n) * math.exp(-model.decay * top)
        yield pa.RecordBatch.from_arrays([pa.array([hits], pa.int64()), pa.array([weight], pa.float64())], names=["hits", "weight"])

    # the most likely K, from d/dK of the sum of log K - K n exp(-lambda S), a text without a segment giving the last term only
    seen = rows.where("label = 0").select("text").mapInArrow(tops, "hits long, weight double").agg(F.sum("hits").alias("hits"), F.sum("weight").alias("weight")).first()
    model.k = max(1e-6, (seen["hits"] + 0.5) / (seen["weight"] + 1))

    def place(batches):
        found = Counter()
        for b in batches:
            for t, y in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
                found[round(evidence(model, t)[0] / BIN) * BIN, y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.float64()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["x", "y", "n"])

    placed = rows.mapInArrow(place, "x double, y int, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    model.slope, model.offset = _logistic({(r["x"], r["y"]): r["n"] for r in placed})
    return model


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, evidence, score and passages (first token, last token, score) of every whole text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            found = [evidence(m, t) for t in texts_of(b.column(1))]
            score = [1 / (1 + math.exp(-max(-30.0, min(30.0, m.slope * x[0] + m.offset)))) for x in found]
            passages = [[{"first": a, "last": z, "score": s} for a, z, s in x[2]] for x in found]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([x[1] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.float64()), pa.array(score, pa.float64()),
                pa.array(passages, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))),
            ], names=["doc_id", "n_tokens", "evidence", "score", "passages"])

    kinds = "doc_id long, n_tokens long, evidence double, score double, passages array<struct<first:int,last:int,score:double>>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kinds)
