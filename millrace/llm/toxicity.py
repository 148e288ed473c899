"""Toxicity by weak supervision.

Voters are words and beginnings of words of a lexicon, mined from labelled training rows, and patterns. Every text is read once for its votes.
A generative label model (two latent classes, each voter with a rate in each class) is fitted by expectation and
maximisation to the votes of all training rows, beginning from the labelled ones; voters that go together within the
toxic class, as the pairwise moments show, share their weight where they fire together. A linear classifier is trained
by Newton's method on the posterior labels that the model gives to all training rows, labelled or not; rows of equal
votes are one weighted row, and tasks add up gradients. It scores every text.

Labels of held-out rows are never read, nor are lang, source or doc_id inputs of a score.

Nulls: a null text is empty; a null doc_id counts as the empty text for the split (crc32 0: held out) and has no label.
Null labels are no labels; a row that is labelled twice counts as toxic if one label is. Repeated rows are scored each.
Without toxic labels every score is 0. If no word tells toxic texts, the patterns vote alone. Empty tables give empty
results. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import join_small, stored, table

#: Labelled training rows that the lexicon is mined from and the label model begins with, at most.
SAMPLE = 8000
#: A word is a voter if it is in so many toxic texts and its log odds are so many deviations above 0.
LEAST = 4
DEVIATIONS = 3.2
#: Other texts that may hold it, for each toxic one; the label model weighs what is left.
PURITY = 0.1
ROUNDS = 5
STEPS = 8
RIDGE = 0.3
#: Parts in which the share of hits is measured.
PARTS = 32
#: Numbers of a matrix of votes that a task holds at a time.
CELLS = 2_000_000
#: Least hashes of five words that tell whether texts are nearly the same: a quarter of them in common.
SKETCH = 24
WORD = re.compile(r"[^\W\d_]+")
#: Patterns: shouting, masked words, hits that repeat, hits that are dense.
PATTERNS = 4
MASKED = re.compile(r"\b\w+\*{2,}\w*")


#: Beginnings that stand for all words that go on from them, as inflected words do.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words that a worker remembers, to look each up once.
REMEMBERED = 300_000


def words_in(text: str) -> list[str]:
    return WORD.findall(text.lower())


def keys_of(word: str) -> list[str]:
    """The entries of a lexicon that a word can match: itself, and its beginnings, marked by a star."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]]


def mined(texts: list[str], toxic: list[bool]) -> list[str]:
    """Words that tell toxic from other texts. Of texts that are nearly the same, one counts."""
    inside, outside, seen = Counter(), Counter(), set()
    n = [0, 0]
    for text, bad in zip(texts, toxic, strict=True):
        words = words_in(text)
        runs = sorted({xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5]).encode()) for i in range(len(words))} or {0})[:SKETCH]
        alike = len(seen.intersection(runs)) * 4 >= len(runs)
        seen.update(runs)
        if alike:
            continue
        n[bad] += 1
        (inside if bad else outside).update({k for w in set(words) for k in keys_of(w)})
    found = []
    for key, p in inside.items():
        q = outside[key]
        odds = math.log((p + 0.5) / (n[1] + 1)) - math.log((q + 0.5) / (n[0] + 1))
        deviation = odds / math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
        if p >= LEAST and deviation >= DEVIATIONS and q <= PURITY * p:
            found.append((-deviation, len(key), key))
    kept: list[str] = []
    for _, _, key in sorted(found):  # what an entry covers, or what covers it, isn't another voter
        stem = key.rstrip("*")
        if not any(stem.startswith(k.rstrip("*")) or k.startswith(stem) for k in kept):
            kept.append(key)
    return kept


class Lexicon:
    """Entries by number; what a word matches is looked up once."""

    def __init__(self, entries: list[str]):
        self.numbers = {k: i for i, k in enumerate(entries)}
        self.known: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.numbers)

    def find(self, word: str) -> int:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        at = self.known[word] = next((self.numbers[k] for k in keys_of(word) if k in self.numbers), -1)
        return at

    def hits(self, words: list[str]) -> list[int]:
        known = self.known.get
        return [at for w in words if (at := self.find(w) if (seen := known(w)) is None else seen) >= 0]


def votes(text: str, lexicon: Lexicon) -> tuple[list[int], int, int]:
    """The voters that fire, words that the lexicon matches, and their share of all words, in parts."""
    words = words_in(text)
    hits = lexicon.hits(words)
    fired, m = sorted(set(hits)), len(lexicon)
    if text.count("!") >= 3:
        fired.append(m)
    if "**" in text and MASKED.search(text):
        fired.append(m + 1)
    if len(hits) >= 3:
        fired.append(m + 2)
    if hits and len(hits) * 100 >= len(words):
        fired.append(m + 3)
    return fired, len(hits), min(PARTS, 20 * len(hits) * PARTS // max(len(words), 1))


@dataclass
class LabelModel:
    prior: float
    rates: np.ndarray  # class x voter
    related: np.ndarray  # voter x voter: correlation within the toxic class

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """Voters that fire share their weight with those related to them that fire too; silent ones with all related."""
        logs, none = np.log(self.rates), np.log1p(-self.rates)
        said = fired * (logs[1] - logs[0]) / (1 + fired @ self.related)
        silent = (1 - fired) * (none[1] - none[0]) / (1 + self.related.sum(0))
        odds = math.log(self.prior / (1 - self.prior)) + said.sum(1) + silent.sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def unpacked(fired, m: int) -> np.ndarray:
    """A row for each list of voters, a column for each voter."""
    out = np.zeros((len(fired), m))
    sizes = [len(f) for f in fired]
    if sum(sizes):
        out[np.repeat(np.arange(len(fired)), sizes), np.concatenate([np.asarray(f, np.int64) for f in fired])] = 1
    return out


def features(fired: np.ndarray, hits: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.c_[fired, hits > 0, np.log1p(hits), share / PARTS, np.ones(len(fired))]


def _pieces(batch: pd.DataFrame, m: int) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Votes unpacked, some rows at a time."""
    step = max(1, CELLS // m)
    for low in range(0, len(batch), step):
        part = batch.iloc[low : low + step]
        yield unpacked(part["fired"].tolist(), m), part


def _summed(patterns: DataFrame, m: int, size: int, add) -> np.ndarray:
    """The sum over all rows of ``add(votes, rows)``, ``size`` numbers, added up by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            for fired, part in _pieces(batch, m):
                total += add(fired, part)
        yield pd.DataFrame({"k": np.flatnonzero(total), "v": total[total != 0]})

    rows = patterns.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[rows["k"].to_numpy(np.int64)] = rows["v"].to_numpy()
    return out


def moments(patterns: DataFrame, model: LabelModel, m: int) -> np.ndarray:
    """Expected sums over all rows under the model: rows, toxic ones, then per class firings, then pairs in the toxic class."""
    held = patterns.sparkSession.sparkContext.broadcast(model)

    def add(fired: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        n = part["n"].to_numpy(float)
        q = held.value.posterior(fired) * n
        return np.r_[n.sum(), q.sum(), (n - q) @ fired, q @ fired, ((fired * q[:, None]).T @ fired).ravel()]

    return _summed(patterns, m, 2 + 2 * m + m * m, add)


def fitted(patterns: DataFrame, fired: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation and maximisation from the labelled rows' rates; then the weights by correlation."""
    m = fired.shape[1]
    rate = lambda rows: (rows.sum(0) + 0.05) / (len(rows) + 1.0)
    model = LabelModel(float(np.clip(toxic.mean(), 0.001, 0.999)), np.stack([rate(fired[~toxic]), rate(fired[toxic])]), np.zeros((m, m)))
    for _ in range(rounds):
        flat = moments(patterns, model, m)
        n, bad = flat[0], flat[1]
        good_fired, bad_fired, pairs = flat[2 : 2 + m], flat[2 + m : 2 + 2 * m], flat[2 + 2 * m :].reshape(m, m)
        mean = bad_fired / max(bad, 1e-9)
        covariance = pairs / max(bad, 1e-9) - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        related = np.clip(covariance / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(related, 0)
        related[related < 0.1] = 0
        # Counts of the labelled rows stay in, so that the classes keep their meaning.
        rates = np.stack([(good_fired + fired[~toxic].sum(0) + 0.05) / (n - bad + (~toxic).sum() + 1), (bad_fired + fired[toxic].sum(0) + 0.05) / (bad + toxic.sum() + 1)])
        model = LabelModel(float(np.clip((bad + toxic.sum()) / (n + len(toxic)), 0.001, 0.999)), np.clip(rates, 1e-7, 1 - 1e-7), related)
    return model


def linear(patterns: DataFrame, model: LabelModel, m: int, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Logistic regression on the posteriors of all rows by Newton's method."""
    size, spark = m + 4, patterns.sparkSession
    w = np.zeros(size)
    for _ in range(steps):
        held = spark.sparkContext.broadcast((model, w))

        def add(fired: np.ndarray, part: pd.DataFrame, held=held) -> np.ndarray:
            model, w = held.value
            x, n = features(fired, part["hits"].to_numpy(), part["share"].to_numpy()), part["n"].to_numpy(float)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            return np.r_[x.T @ (n * (p - model.posterior(fired))), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()]

        flat = _summed(patterns, m, size + size * size, add)
        step = np.linalg.solve(flat[size:].reshape(size, size) + ridge * np.eye(size), flat[:size] + ridge * w)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-3:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    held_out = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), "toxic").filter("label_id is not null and toxic is not null").filter(~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    picked = stored(known.orderBy(F.xxhash64("label_id"), "label_id").limit(sample), "labelled")
    some = join_small(rows, picked, F.col("doc_id") == F.col("label_id"), "inner", sample).select("doc_id", "t", "toxic")
    fit = some.toPandas().sort_values(["doc_id", "t"]).drop_duplicates("doc_id").head(sample)  # at most ``sample`` rows
    texts, toxic = [t or "" for t in fit["t"]], fit["toxic"].to_numpy(int) > 0
    lexicon = Lexicon(mined(texts, toxic.tolist()) if toxic.any() and not toxic.all() else [])
    m = len(lexicon) + PATTERNS
    held_lexicon = spark.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lexicon = held_lexicon.value
            fired, hits, share = [], [], []
            for t in batch.column(1):
                found = votes(t.as_py() or "", lexicon)
                fired.append(found[0])
                hits.append(found[1])
                share.append(found[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fired, pa.list_(pa.int32())), pa.array(hits, pa.int64()), pa.array(share, pa.int32())], ["doc_id", "fired", "hits", "share"])

    voted = stored(rows.mapInArrow(vote, "doc_id long, fired array<int>, hits long, share int").withColumn("held_out", held_out(F.col("doc_id"))), "votes")
    if not toxic.any():
        return voted.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    patterns = stored(voted.filter(~F.col("held_out")).groupBy("fired", "hits", "share").agg(F.count(F.lit(1)).alias("n")), "patterns")
    fired = unpacked([votes(t, lexicon)[0] for t in texts], m)
    weights = linear(patterns, fitted(patterns, fired, toxic), m)
    held = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, part in _pieces(batch, m):
                p = 1 / (1 + np.exp(-np.clip(features(x, part["hits"].to_numpy(), part["share"].to_numpy()) @ held.value, -30, 30)))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return voted.mapInPandas(score, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
