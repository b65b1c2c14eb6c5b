"""Operator 9: the likelihood against a plain version, the choice of features, grades of any kind, held-out accuracy."""

import io
import math
import os

import numpy as np
import pytest

from bundlelens.llm import quality

SF_DIR = "/root/testdata/sf0.01"


def plain_loss(grade, score, theta):
    """-log likelihood of ordered grades, one document at a time."""
    thresholds = [theta[0]]
    for t in theta[1:]:
        thresholds.append(thresholds[-1] + math.exp(t))
    total = 0.0
    for g, s in zip(grade, score):
        above = lambda k: 1.0 if k < 0 else 0.0 if k == len(thresholds) else 1 / (1 + math.exp(thresholds[k] - s))
        total -= math.log(above(g - 1) - above(g))
    return total / len(grade)


@pytest.mark.parametrize("grades", [2, 3, 5])
def test_likelihood_and_slopes(grades):
    random = np.random.default_rng(grades)
    grade, score, theta = random.integers(0, grades, 40), random.normal(size=40), random.normal(size=grades - 1)
    loss, by_score, by_theta = quality.slopes(grade, score, theta)
    assert math.isclose(loss, plain_loss(grade, score, theta), rel_tol=1e-12)
    shift = 1e-6
    for i in range(40):
        moved = score + shift * (np.arange(40) == i)
        assert math.isclose(by_score[i], (plain_loss(grade, moved, theta) - loss) / shift, abs_tol=1e-6)
    for k in range(grades - 1):
        moved = theta + shift * (np.arange(grades - 1) == k)
        assert math.isclose(by_theta[k], (plain_loss(grade, score, moved) - loss) / shift, abs_tol=1e-5)


def test_words_met_once_get_no_weight():
    random = np.random.default_rng(2)
    rows = []
    for i in range(4000):
        bad = i < 67  # a rare grade, as in the tables
        words = [int(w) for w in random.integers(100, 1000, 20)] + [10_000 + i]
        rows.append((0 if bad else 2, sorted({*words, *([7] if bad and i % 2 else [])})))
    model = np.load(io.BytesIO(quality.fit(rows)))
    weights = model["weights"]
    assert weights[7] < -1 and not weights[10_000:14_000].any() and (weights[100:1000] != 0).sum() <= 2
    counts, totals = np.zeros((2, 500), int), np.array([67, 3933])
    counts[1, 4:] = 9
    counts[:, 0], counts[:, 1], counts[:, 2], counts[:, 3] = (1, 0), (2, 3), (20, 0), (60, 3900)
    assert quality.chosen(counts, totals).tolist() == [2]


def test_grades_are_those_of_the_ratings(spark):
    texts = spark.createDataFrame([(i, f"{'awful' if i % 4 == 0 else 'calm' if i % 4 < 3 else 'great'} text {i}") for i in range(600)],
                                  "doc_id bigint, text string").withColumn("tail", quality.F.lit("old"))
    ratings = texts.selectExpr("doc_id", "if(doc_id % 4 = 0, -1, if(doc_id % 4 < 3, 3, 7)) as grade")
    odd = spark.createDataFrame([(None, 3), (5, None), (10_000, 3)], "doc_id bigint, grade int")
    model = quality.train(texts, ratings.union(odd))
    rated = quality.rate(texts, model)
    assert rated.columns == ["doc_id", "text", "expected_grade", "tail", "kept"]
    for r in rated.collect():
        place = 0 if r["doc_id"] % 4 == 0 else 1 if r["doc_id"] % 4 < 3 else 2
        assert abs(r["expected_grade"] - (-1, 3, 7)[place]) < 1 and r["kept"] == (place == 2)
    middle = quality.rate(texts, model, grade=3).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 > 0) for r in middle)
    assert not any(r["kept"] for r in quality.rate(texts, model, grade=8).collect())
    alone = quality.train(texts, ratings.filter("grade = 3"))
    assert {(r["expected_grade"], r["tail"], r["kept"]) for r in quality.rate(texts, alone).collect()} == {(3.0, 1.0, True)}


def test_all_features_of_long_documents_count(spark):
    filler = " ".join(f"word{i}" for i in range(6000))
    rows = [(i, f"{filler} {'vile' if i % 2 else 'kind'}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = quality.train(docs, docs.selectExpr("doc_id", "if(doc_id % 2 = 1, 0, 1) as grade"))
    assert all(r["kept"] == (r["doc_id"] % 2 == 0) for r in quality.rate(docs, model).collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_held_out_ratings(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").selectExpr("doc_id", "quality + 1 - toxic as grade", "crc32(cast(doc_id as string)) % 3 = 0 as held")
    model = quality.train(docs, labels.filter("not held"))
    rated = quality.rate(docs, model, carry=["doc_id"]).join(labels.filter("held"), "doc_id").collect()
    good = [r["kept"] for r in rated if r["grade"] == 2]
    assert sum(good) >= 0.95 * len(good) > 0
