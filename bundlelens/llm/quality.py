"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundlelens.llm.bpe import ship
from bundlelens.llm.common import annotate, col, held
from bundlelens.llm.crf import Adam, packed
from bundlelens.session import written

BUCKETS = 1 << 18
SAMPLE_ROWS = 8_000
"""Rated documents that the model is fitted on: those with the smallest hashes."""
CHANCE = 0.05
"""The share of the features with a weight that may have nothing to do with the grades."""
STEPS = 600
DECAY = 1e-5
CACHE_WORDS = 300_000
LONG_WORD = 64
"""Letters from which a token is also read by what is inside it."""
ODD = re.compile(r"[^\w\s.,;:'’-]")

def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def _inside(token: str) -> set[str]:
    """The features in a long token: its parts between signs, and the letter pairs and triples of a long part."""
    letters = "".join([c if c.isalnum() or unicodedata.category(c)[0] == "M" else " " for c in token.lower()])
    found = set()
    for part in set(letters.split()):
        found.add("w" + part)
        if len(part) > LONG_WORD:
            for size in (2, 3):
                found.update([f"g{part[i:i + size]}" for i in range(len(part) - size + 1)])
    return found


class Tokens(dict):
    """For each token: its features and, for the shares, whether it shouts and whether it holds odd signs.

    The features are the word and its odd signs, four at a time; of long tokens, which are not kept, also what is inside.
    """

    def __missing__(self, token: str):
        names = {"w" + token.strip(".,;:!?\"'()[]{}*#$%&|").lower()}
        signs = "".join(ODD.findall(token))
        names.update(["s" + signs[i:i + 4] for i in range(0, len(signs), 4)])
        if len(token) > LONG_WORD:
            names |= _inside(token)
        found = (tuple(map(_bucket, names)), token.isupper() and len(token) > 1, bool(signs))
        if len(token) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[token] = found
        return found


def features(text: str | None, tokens: Tokens) -> list[int]:
    """The distinct hashed features of a whole text: words, odd signs, and the shares of shouting, odd signs and repeats."""
    parts = text.split() if text else []
    found = {_bucket(f"n{int(math.log2(len(parts) + 1))}")}
    if parts:
        distinct = set(parts)
        known = [tokens[t] for t in distinct]
        share = [0, 0]
        for k in known:
            found.update(k[0])
            share[0] += k[1]
            share[1] += k[2]
        found.add(_bucket(f"upper{10 * share[0] // len(distinct)}"))
        found.add(_bucket(f"odd{10 * share[1] // len(distinct)}"))
        found.add(_bucket(f"distinct{10 * len(distinct) // len(parts)}"))
    return sorted(found)


def chosen(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The features that get a weight, from the numbers of documents per grade (rows) that hold each (columns) and per grade.

    For a feature in n documents, a share p of them of a grade whose share of all is q, Chernoff's bound on the chance of a share as
    far from q is exp(-n KL(p, q)). Features are taken by rising bounds as long as no more than ``CHANCE`` of
    them are expected to be there by chance (Benjamini and Hochberg), so a word that is met once, or a few times
    among many words, is no evidence.
    """
    seen = counts.sum(axis=0)
    q = (totals / totals.sum())[:, None]
    p = counts / np.maximum(seen, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(p > 0, p * np.log(p / q), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - q)), 0)
    evidence = (seen * np.where(q < 1, gap, 0)).max(axis=0)
    order = np.argsort(-evidence, kind="stable")[:int((seen > 0).sum())]
    needed = math.log(max(1, len(order)) * len(totals) / CHANCE) - np.log(np.arange(1, len(order) + 1))
    enough = np.flatnonzero(evidence[order] >= needed)
    return np.sort(order[:enough[-1] + 1]) if len(enough) else order[:0]


def slopes(grade: np.ndarray, score: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean of -log likelihood, its slopes by each score, by each theta) for places of grades 0, 1, ….

    P(place > k) is sigmoid(score - threshold k); the thresholds are theta 0 plus the running sum of exp(theta k), so
    they stay in order.
    """
    rows, n = np.arange(len(grade)), len(grade)
    thresholds = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
    tail = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -30, 30)))
    # The likelihood of a grade is the difference of neighbouring tails.
    bounds = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
    slope = bounds * (1 - bounds)
    chance = np.maximum(bounds[rows, grade] - bounds[rows, grade + 1], 1e-9)
    into, out = slope[rows, grade] / chance, slope[rows, grade + 1] / chance
    by_threshold = np.array([into[grade == k + 1].sum() - out[grade == k].sum() for k in range(len(theta))]) / n
    by_theta = np.array([by_threshold.sum()] + [by_threshold[k:].sum() * math.exp(theta[k]) for k in range(1, len(theta))])
    return float(-np.log(chance).mean()), (out - into) / n, by_theta


def fit(rows, steps: int = STEPS, features_used: np.ndarray | None = None) -> bytes:
    """The model for (grade, features) rows: grades in order, thresholds between them and the weights they all share.

    Only ``features_used`` get a weight; without them they are chosen from the rows.
    """
    rows = [(g, np.asarray(f, np.int64)) for g, f in rows]
    weights = np.zeros(BUCKETS)
    grades, grade = np.unique([g for g, _ in rows], return_inverse=True)
    if len(grades) < 2:
        return packed(weights=weights.astype("f4"), thresholds=np.zeros(0), grades=grades.astype(float))
    sizes = np.array([len(f) for _, f in rows])
    flat = np.concatenate([f for _, f in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    if features_used is None:
        counts = np.stack([np.bincount(flat[grade[owner] == k], minlength=BUCKETS) for k in range(len(grades))])
        features_used = chosen(counts, np.bincount(grade))
    used = np.isin(flat, features_used)
    flat, owner = flat[used], owner[used]
    theta = np.array([-1.0] + [0.0] * (len(grades) - 2))
    step = Adam([weights, theta], 0.1)
    for _ in range(steps):
        _, by_score, by_theta = slopes(grade, np.bincount(owner, weights[flat], len(grade)), theta)
        step([np.bincount(flat, by_score[owner], BUCKETS) + DECAY * weights, by_theta])
    thresholds = np.concatenate([theta[:1], theta[0] + np.cumsum(np.exp(theta[1:]))])
    return packed(weights=weights.astype("f4"), thresholds=thresholds, grades=grades.astype(float))


def _one(df: DataFrame, make) -> bytes:
    """What ``make`` gives for the rows of a small table, as columns of its batches, in one task."""
    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([make(batches)], pa.binary())], names=["made"])

    found = df.repartition(1).mapInArrow(run, "made binary").first()
    return bytes(found["made"]) if found else make(iter(()))


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4")


def train(docs: DataFrame, ratings: DataFrame, text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> bytes:
    """Fits the model on the ``rows`` rated documents (``key``, ``grade``: any numbers) with the smallest hashes.

    A document with several ratings counts with the lowest. Ratings without key or grade are left out; grades are what the
    ratings hold. All features of a rated document count: they are counted per grade where they are found, and those
    chosen by the counts go to the one task that fits; the driver gets the model only.
    """
    rated = ratings.filter(col(key).isNotNull() & F.col("grade").isNotNull()).groupBy(col(key).alias("_key")).agg(
        F.min(F.col("grade").cast("double")).alias("_grade")).orderBy(F.xxhash64("_key", F.lit(3)), "_key").limit(rows)
    # At most ``rows`` rows of two numbers: small enough to broadcast whatever the corpus.
    texts = docs.select(col(key).alias("_id"), col(text).alias("text")).join(F.broadcast(rated), F.col("_id") == F.col("_key"))

    def make():
        tokens = Tokens()
        return lambda values: [[np.array(features(t, tokens), "<i4").tobytes() for t in values]]

    found = annotate(texts.select("_id", "_grade", "text"), "text", [("features", "binary")], make, carry=["_id", "_grade"])
    one = written(found.groupBy("_id", "_grade").agg(F.min("features").alias("features")), "rated")

    def count(batches):
        held: dict[float, np.ndarray] = {}
        for batch in batches:
            for grade, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers = held.setdefault(grade, np.zeros(BUCKETS, np.int64))
                numbers[_numbers(data)] += 1
        for grade, numbers in held.items():
            at = np.flatnonzero(numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), grade)), pa.array(at, pa.int32()), pa.array(numbers[at], pa.int64())], names=["grade", "feature", "n"])

    totals = {r["_grade"]: r["count"] for r in one.groupBy("_grade").count().collect()}
    grades = sorted(totals)
    counts = one.select("_grade", "features").mapInArrow(count, "grade double, feature int, n bigint").groupBy(
        "grade", "feature").agg(F.sum("n").alias("n"))

    def choose(batches):
        table = np.zeros((len(grades), BUCKETS), np.int64)
        for batch in batches:
            grade, feature, n = (column.to_numpy() for column in batch.columns)
            table[np.searchsorted(grades, grade), feature] = n
        return chosen(table, np.array([totals[g] for g in grades])).astype("<i4").tobytes() if grades else b""

    kept = _one(counts, choose)

    def narrow(batches):
        used = _numbers(kept)
        for batch in batches:
            lists = [np.intersect1d(_numbers(data), used).astype("<i4").tobytes() for data in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], names=["id", "grade", "features"])

    def learn(batches):
        held = sorted(row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        return fit([(grade, _numbers(data)) for _, grade, data in held], features_used=_numbers(kept))

    return _one(one.select(F.col("_id").cast("string"), "_grade", "features").mapInArrow(narrow, "id string, grade double, features binary"), learn)


def _model(name: str):
    def build():
        model = np.load(SparkFiles.get(name))
        return model["weights"].astype(float), model["thresholds"], model["grades"], Tokens()
    return held(name, build)


def rate(docs: DataFrame, model: bytes, grade: float | None = None, least: float = 0.5, text: str = "text", carry=None) -> DataFrame:
    """Adds ``expected_grade``, ``tail`` (the probability of ``grade`` or better, by default the best) and ``kept`` (``tail`` of ``least`` or more).

    Whole texts are scored where they lie, without a shuffle. Null and empty texts have only the feature of their length and
    are rated by it. A model of one grade expects that grade, one without ratings expects 0, and both keep everything. An empty table gives
    an empty one. Input columns named like a result give way to it.
    """
    name = ship(docs.sparkSession, model, "quality")

    def make():
        weights, thresholds, grades, tokens = _model(name)
        place = len(grades) - 1 if grade is None else int(np.searchsorted(grades, grade))

        def step(texts):
            scores = np.array([weights[features(t, tokens)].sum() for t in texts])
            tails = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds, -30, 30)))
            reached = np.concatenate([np.ones((len(texts), 1)), tails, np.zeros((len(texts), 1))], axis=1)[:, max(0, place)]
            expected = (grades[0] if len(grades) else 0.0) + tails @ np.diff(grades)
            return [expected, reached, reached >= least]
        return step

    return annotate(docs, text, [("expected_grade", "double"), ("tail", "double"), ("kept", "boolean")], make, carry)
