"""Toxicity by weak supervision (operator 6).

1. Lexicons: over labelled rows, one of each group of near copies, every word and word start (4 to 7 letters) is
   counted in toxic and other documents. Those whose likelihood ratio is beyond chance, given how many were looked at, are the lexicon, one voter each. Pattern voters
   see shouting, exclamation marks, runs of signs and repeated words. The annotator's label is a voter too.
2. Label model: a generative model with a class prior and, for each voter, the chance to fire given either class, fitted by expectation
   maximisation. Pairwise correlations given the class are estimated from the posteriors, and a voter's evidence is
   divided by the number of voters that it effectively repeats, so that a word and its starts count once.
3. Classifier: logistic regression on the voters' features, trained on the posterior labels.

Only labelled rows with ``crc32(doc_id as text) mod 3 <> 1`` are used for learning, at most ``SAMPLE_ROWS`` of them (those with the smallest
hash of their id; the documented bound of what reaches the driver is that many rows of at most ``LEXICON`` marks).
Labels, language, source and id are no input of a score. Every whole text of the table is scored.

A null or empty text has no voter and gets the classifier's base score. Without usable labels every score is (almost) 0.
Equal texts get equal scores. A document with several labels counts as toxic when one of them says so. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table

SAMPLE_ROWS = 20_000
LEXICON = 1_000
STARTS = (4, 5, 6, 7)
MIN_TOXIC, MIN_RATIO = 4, 5.0
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 300_000
PATTERNS = ("shouting", "marks", "signs", "repeats")


def features(token: str) -> list[str]:
    """Words of a token, in lower case, and their starts (``word*``)."""
    out = []
    for w in LETTERS.findall(token.lower()):
        out.append(w)
        out += [f"{w[:k]}*" for k in STARTS if len(w) >= k]
    return out


def pattern_marks(text: str, tokens: list[str], distinct: int) -> list[bool]:
    """Pattern voters: much upper case, many exclamation marks, many other signs, few different words."""
    n, size = max(len(tokens), 1), max(len(text), 1)
    letters = sum(map(text.count, "abcdefghijklmnopqrstuvwxyz"))
    signs = sum(map(text.count, "#$%&*|~^"))
    return [size > 20 and letters < 0.2 * size, text.count("!") > 0.1 * n, signs > 0.3 * n, n >= 20 and distinct < 0.2 * n]


class Marker:
    """Finds which lexicon entries and patterns a text shows; remembers the entries of a bounded number of tokens."""

    def __init__(self, lexicon: list[str]):
        self.place = {w: i for i, w in enumerate(lexicon)}
        self.size = len(lexicon)
        self.known: dict[str, tuple[int, ...]] = {}

    def marks(self, text: str | None) -> list[int]:
        tokens = (text or "").split()
        distinct = set(tokens)
        found: set[int] = set()
        known = self.known
        for t in distinct:
            hit = known.get(t)
            if hit is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                hit = known[t] = tuple({self.place[f] for f in features(t) if f in self.place})
            if hit:
                found.update(hit)
        return sorted(found) + [self.size + i for i, x in enumerate(pattern_marks(text or "", tokens, len(distinct))) if x]


# ---------- learning ----------

def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, toxic`` of the labelled rows that may be learnt from, one for each group of near copies.

    The sampled ids are at most ``sample`` rows. Rows of one class with the same smallest hash of a word triple count as near copies."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    ids = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    words = F.split("text", r"\s+")
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 3)))
    one = rows.withColumn("w", words).withColumn("near", F.array_min(triples)).groupBy("near", "toxic").agg(F.min_by("text", "doc_id").alias("text"))
    return one.select("text", "toxic")


def mine_lexicon(rows: DataFrame, limit: int = LEXICON) -> list[str]:
    """Words and starts whose presence speaks for a toxic document, by log-likelihood ratio."""

    def run(batches):
        seen, toxic = Counter(), Counter()
        n = [0, 0]
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {f for t in set((text or "").split()) for f in features(t)}
                n[y] += 1
                (toxic if y else seen).update(found)
            if len(seen) + len(toxic) > 500_000:
                yield flush(seen, toxic, [0, 0])
                seen, toxic = Counter(), Counter()
        yield flush(seen, toxic, n)

    def flush(seen, toxic, n):
        names = [*{*seen, *toxic}, ""]
        return pa.RecordBatch.from_pydict({"f": names, "clean": [seen[w] for w in names[:-1]] + [n[0]], "toxic": [toxic[w] for w in names[:-1]] + [n[1]]})

    counts = rows.mapInArrow(run, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = settle(counts.where((F.col("toxic") >= MIN_TOXIC) | (F.col("f") == "")))
    total = counts.where(F.col("f") == "").first()
    if total is None or not total.toxic or not total.clean:
        return []
    beyond_chance = 2 * math.log(2 * max(counts.count(), 10))  # less than one chance find among all that were counted
    a, b, n1, n0 = F.col("toxic"), F.col("clean"), total.toxic, total.clean
    base = n1 / (n1 + n0)
    ratio = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    gain = 2 * (a * F.log(a / ((a + b) * base)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0.0))
    top = counts.where((F.col("f") != "") & (ratio >= MIN_RATIO) & (gain >= beyond_chance)).orderBy(F.desc(gain), "f").limit(limit)
    return [r.f for r in top.select("f").collect()]


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of the toxic class for each row, accuracies (chance to fire given toxic and given clean), weights by correlation, prior.

    ``votes`` is rows x voters, 0 or 1. ``start`` marks rows that are toxic at first.
    """
    v = votes.astype(np.float64)
    post = np.where(start > 0, 0.9, 0.05)
    weight = np.ones(v.shape[1])
    for step in range(rounds):
        prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
        fire1 = (post @ v + 0.5) / (post.sum() + 1)
        fire0 = ((1 - post) @ v + 0.05) / ((1 - post).sum() + 1)
        if step % 10 == 0:
            weight = 1 / effective_copies(v, post)
        on = np.log(fire1 / fire0) * weight
        off = np.log((1 - fire1) / (1 - fire0)) * weight
        logit = np.log(prior / (1 - prior)) + v @ on + (1 - v) @ off
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, np.stack([fire1, fire0]), weight, prior


def effective_copies(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    """For each voter the sum of its squared positive correlations with all voters among probably toxic rows (itself: 1)."""
    w = post / max(post.sum(), 1e-9)
    mean = w @ v
    c = (v * w[:, None]).T @ v - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c), 1e-12))
    r = np.clip(c / np.outer(sd, sd), 0, 1)
    np.fill_diagonal(r, 1)
    return (r ** 2).sum(axis=1)


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; the base score is not penalised."""
    a = np.concatenate([x.astype(np.float64), np.ones((len(x), 1))], axis=1)
    reg = np.full(a.shape[1], penalty)
    reg[-1] = 1e-3
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(reg + 1e-6), a.T @ (p - target) + reg * beta)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, float]:
    """Lexicon, weights (lexicon then patterns) and base of the classifier."""
    rows = settle(training_rows(docs, labels, sample))
    lexicon = mine_lexicon(rows)
    if not lexicon:
        return [], np.zeros(len(PATTERNS)), -30.0

    def run(batches):
        marker = Marker(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([marker.marks(t) for t in b.column(0).to_pylist()], pa.list_(pa.int32())), b.column(1).cast(pa.int32())], names=["marks", "toxic"])

    found = rows.mapInArrow(run, "marks array<int>, toxic int").groupBy("marks", "toxic").count().collect()  # at most SAMPLE_ROWS rows
    size = len(lexicon) + len(PATTERNS)
    x = np.zeros((sum(r["count"] for r in found), size), dtype=np.int8)
    label = np.zeros(len(x), dtype=np.int8)
    at = 0
    for r in sorted(found, key=lambda r: (r["marks"], r["toxic"])):
        x[at:at + r["count"], r["marks"]] = 1
        label[at:at + r["count"]] = r["toxic"]
        at += r["count"]
    # patterns abstain where no lexicon voter would back them, so that they inform but do not define the class
    votes = x.copy()
    votes[~x[:, :len(lexicon)].any(axis=1), len(lexicon):] = 0
    posterior = label_model(np.concatenate([votes, label[:, None]], axis=1), label)[0]
    weights, base = fit_linear(x, posterior)
    return lexicon, weights, base


# ---------- scoring ----------

def score_texts(docs: DataFrame, lexicon: list[str], weights: np.ndarray, base: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, text_hash, score`` of every row."""

    def run(batches):
        marker = Marker(lexicon)
        for b in batches:
            z = np.array([weights[marker.marks(t)].sum() for t in b.column(2).to_pylist()]) + base
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["key", "text_hash", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, text_hash long, score double").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text_hash, score`` with a classifier learnt from the labelled rows of ``docs``."""
    return score_texts(docs, *learn(docs, labels, sample))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    lexicon, weights, base = learn(docs, labels)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        marker = Marker(lexicon)
        z = np.array([weights[marker.marks(t)].sum() for t in text], dtype=np.float64) + base
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.where(score(F.col("text").cast("string")) < threshold)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
