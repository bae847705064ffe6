"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model over features of the whole text gives each document's own
odds. It is fitted on a bounded sample of labelled rows (``FIT_ROWS``, the
least hashes of their ids). Over all documents the expected number of good ones
is summed for each (host, path) and host. A host's posterior shrinks its mean
towards the global one by a strength that the method of moments finds from the
spread between hosts; a path's shrinks towards its host's, likewise. A document
is left out of its own site's sums, and its final log-odds are its own plus
what its path's posterior differs from the global rate, weighted by
``SITE_WEIGHT``.

Defined results: an empty or null text is scored by its features (all zero); a
null host or path is a site of its own; a null doc_id is carried and never
learned from; repeated rows each get their row; without labels of both kinds
every document has the prior 0.5 and is kept; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, salted_lookup, settle, texts_of, train_fold

FIT_ROWS = 20_000
SITE_WEIGHT = 0.5
THRESHOLD = 0.5

_marks = re.compile(r"[#*$%&|<>!{}~^=\\]").findall
_not_letters = re.compile(r"[\W\d_]").findall
FEATURES = 10


def features(text: str) -> list[float]:
    """Shares and lengths of a whole text, each of order one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    lines = [x for x in text.split("\n") if x.strip()]
    letters = len(text) - len(_not_letters(text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    same = sum(a == b for a, b in zip(words, words[1:]))
    distinct = len(set(words))
    return [
        math.log1p(n) / 5,
        len(text) / n / 8,
        min(3.0, 10 * len(_marks(text)) / n),
        upper / max(1, letters) * 2,
        3 * same / n,
        distinct / n,
        distinct / n * math.log1p(n) / 5,
        1 - len(set(lines)) / max(1, len(lines)),
        10 * sum(map(text.count, "0123456789")) / len(text),
        2 * letters / len(text),
    ]


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps over the features, their squares and one."""
    design = _design(x)
    beta = np.zeros(design.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 0.1 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _design(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x, np.ones((len(x), 1))])


def _strength(mean: float, spread: float, groups: float, rows: float) -> float:
    """Prior rows that a group's mean is worth, by the method of moments from the weighted variance between groups."""
    within = max(1e-9, mean * (1 - mean))
    between = spread - within * max(0.0, groups - 1) / max(1.0, rows)
    return float(min(1e6, max(1.0, within / max(between, 1e-9))))


def quality_scores(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality") -> DataFrame:
    """doc_id, document_score, host_posterior, path_posterior, score and kept for every row of ``documents``."""
    spark = documents.sparkSession

    def run(batches):
        for b in batches:
            found = np.array([features(t) for t in texts_of(b.column(3))], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "host", "path", "x"])

    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00null"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), site(host).alias("host"), site(path).alias("path"), F.col("text").cast("string").alias("text"))
    each = settle(docs.mapInArrow(run, "doc_id long, host string, path string, x array<double>"), "quality-features")

    known = labels.where(train_fold(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    labelled = settle(each.select("doc_id", "x").join(known, "doc_id"), "quality-labelled")
    sample = first_by_hash(labelled, "doc_id", FIT_ROWS, labelled.count()).select("x", "y").collect()
    y = np.array([r["y"] for r in sample])
    beta = _fit(np.array([r["x"] for r in sample]), y) if len(set(y)) == 2 else np.zeros(2 * FEATURES + 1)

    weights = [float(b) for b in beta]
    logit = F.lit(weights[-1])
    for i in range(FEATURES):
        v = F.col("x")[i]
        logit = logit + v * weights[i] + v * v * weights[FEATURES + i]
    clipped = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), logit))
    scored = each.select("doc_id", "host", "path", clipped.alias("own")).withColumn("p", 1 / (1 + F.exp(-F.col("own"))))

    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("k"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hk").alias("k"), F.count(F.lit(1)).alias("g"), F.sum(F.col("hk") * F.col("hk") / F.col("hn")).alias("q")).first()
    rows = float(total["n"] or 0)
    mean = float(total["k"] or 0) / rows if rows else 0.5
    mean = min(1 - 1e-6, max(1e-6, mean))
    host_strength = _strength(mean, float(total["q"] or 0) / rows - mean * mean if rows else 0.0, float(total["g"]), rows)
    inner = paths.join(hosts, "host").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("hk") / F.col("hn"), 2)).alias("q"), F.count(F.lit(1)).alias("g")).first()
    path_strength = _strength(mean, float(inner["q"] or 0) / rows if rows else 0.0, float(inner["g"]) - float(total["g"]) + 1, rows)

    sites = paths.join(hosts, "host")
    both = salted_lookup(scored, sites, ["host", "path"], "left", F.monotonically_increasing_id())
    on_host = (F.col("hk") - F.col("p") + host_strength * mean) / (F.col("hn") - 1 + host_strength)
    out = both.withColumn("host_posterior", on_host).withColumn("path_posterior", (F.col("k") - F.col("p") + path_strength * F.col("host_posterior")) / (F.col("n") - 1 + path_strength))
    clip = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_posterior")))
    final = F.col("own") + SITE_WEIGHT * (F.log(clip / (1 - clip)) - math.log(mean / (1 - mean)))
    score = 1 / (1 + F.exp(-final))
    return out.select("doc_id", F.col("p").alias("document_score"), "host_posterior", "path_posterior", score.alias("score"), (score >= THRESHOLD).alias("kept"))
