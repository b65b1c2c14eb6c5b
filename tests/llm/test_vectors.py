"""Operators 11 and 12 against brute force, and on nulls, ties, repeats, odd lengths, empty tables, clashing names."""

import hashlib
import math

import numpy as np
import pytest

from bundlelens.llm import bidiagonal, vector_codes, whitening
from bundlelens.llm.vectors import packed, unpacked

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, component string, c0 int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "old", "old", 7) for i, v, label in rows], SCHEMA)


@pytest.fixture
def rows():
    random = np.random.default_rng(4)
    whole = (random.integers(-300, 300, (320, 8)) / 256).astype("f4")
    out = [(i, v.tolist(), int(i % 3) if i % 7 else None) for i, v in enumerate(whole)]
    out += [(900, None, 1), (901, [1.0, None] + [0.0] * 6, 1), (902, [math.nan] * 8, 1), (903, [math.inf] + [0.0] * 7, None)]
    out += [(5, out[5][1], 2), (5, out[5][1], 2), (None, out[6][1], None), (950, [0.5, 0.25], 1), (951, [], 1), (952, [3e38] * 8, 1)]
    return out + [(960 + i, out[9][1], 4) for i in range(40)]


def kept(rows, scale, limit=1 << 24):
    sound = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return sound, [[max(-limit, min(limit, math.floor(scale * x))) for x in v] + [0] * (8 - len(v)) for _, v, _ in sound]


def codes_by_brute_force(rows, entries, rounds):
    sound, x = kept(rows, 1024.0)
    order = sorted(range(len(x)), key=lambda i: (sound[i][0] is None, sound[i][0] or 0, list(sound[i][1])))
    books = [[x[i][2 * p:2 * p + 2] for i in order[:entries]] for p in range(4)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for v in x:
                groups.setdefault(nearest(p, v[2 * p:2 * p + 2])[1], []).append(v[2 * p:2 * p + 2])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else old for e, old in enumerate(books[p])]
    found = [[nearest(p, v[2 * p:2 * p + 2]) for p in range(4)] for v in x]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), error in zip(sound, errors):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((str(s[0]), "".join(f"{e:02x}" for _, e in f), error, by_label[s[2]], digest)
                  for s, f, error in zip(sound, found, errors))


@pytest.mark.parametrize("entries, rounds", [(16, 3), (256, 1)])
def test_codes_against_brute_force(spark, rows, entries, rounds):
    got = vector_codes.compress(table(spark, rows), entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "embedding", "label", "component", "c0", "code", "error", "label_error", "codebooks_sha256"]
    picked = got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted((str(r[0]), *r[1:]) for r in picked) == codes_by_brute_force(rows, entries, rounds)


def test_codes_with_many_labels_are_joined(spark, rows, monkeypatch):
    expected = {tuple(r) for r in vector_codes.compress(table(spark, rows), entries=16, rounds=1, carry=["vec_id"]).collect()}
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert {tuple(r) for r in vector_codes.compress(table(spark, rows), entries=16, rounds=1, carry=["vec_id"]).collect()} == expected


def test_trie_shares_prefixes_across_runs(monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAVES", 7)
    random = np.random.default_rng(2)
    parts = np.unique(random.integers(-2, 3, (400, 6)), axis=0)
    entries = random.integers(-2, 3, (20, 6))
    for book in (entries, entries * 2 ** 20):
        nearest, distance = vector_codes.Trie(book).leaves(parts)
        plain = ((parts[:, None] - book) ** 2).sum(-1)
        assert (nearest == plain.argmin(1)).all() and (distance == plain.min(1)).all()


def test_packed_order():
    values = np.array([[-2 ** 24, 3], [-1, 5], [0, -7], [0, 2], [2 ** 24, 0]])
    data = packed(values)
    assert data.to_pylist() == sorted(data.to_pylist()) and (unpacked(data, 2) == values).all()


def test_empty_tables(spark, rows):
    for empty in (table(spark, rows).filter("false"), table(spark, rows).filter("embedding is null")):
        assert vector_codes.compress(empty).count() == 0 and whitening.whiten(empty).count() == 0
    alone = table(spark, [(1, [], None), (2, [], 3)])
    assert {(r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(alone).collect()} == {("00000000", 0, 0)}
    assert whitening.whiten(alone).count() == 0


def test_whitening_against_eigenvectors(spark, rows):
    rows = [r for r in rows if r[0] != 952]
    got = whitening.whiten(table(spark, rows).drop("component"), carry=["vec_id", "code", "c0"]).collect()
    sound, x = kept(rows, 256.0)
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    expected = {}
    for (key, _, _), v in zip(sound, x):
        z = (np.array(v) - np.array(sums) / n) @ axes[:, :4] / np.sqrt(values[:4])
        expected.setdefault(key, []).append((sum((n * a - s) ** 2 for a, s in zip(v, sums)), z))
    assert len(got) == 4 * len(x) and {r["c0"] for r in got} == {7}
    signs = {}
    for r in got:
        deviation, z = expected[r["vec_id"]][0]
        at = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation) and math.isclose(abs(r["whitened"]), abs(z[at]), abs_tol=1e-9)
        if abs(z[at]) > 1e-6:
            signs.setdefault(at, set()).add(r["whitened"] * z[at] > 0)
        assert math.isclose(r["explained"], values[at] / values.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_of_flat_and_short_tables(spark):
    same = whitening.whiten(table(spark, [(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 2)])).collect()
    assert len(same) == 4 and {(r["whitened"], r["explained"], r["identity_error"], r["n"]) for r in same} == {(0.0, 0.0, 0.0, 1)}
    line = whitening.whiten(table(spark, [(i, [i / 4, i / 2, 0.0], 1) for i in range(5)])).collect()
    first = [r["whitened"] for r in line if r["component"] == 1]
    assert np.allclose(np.var(first), 1) and {r["whitened"] for r in line if r["component"] > 1} == {0.0}
    huge = whitening.whiten(table(spark, [(1, [3e38, -3e38], 1), (2, [0.0, 1.0], 2)])).collect()
    assert len(huge) == 4 and all(math.isfinite(r["whitened"]) for r in huge)


def test_long_sums_are_exact():
    random = np.random.default_rng(6)
    x = random.integers(-2 ** 24, 2 ** 24, (5, 3))
    sums = [2 ** 60 + 12345, -(2 ** 59) - 77, 3]
    model = whitening.Whitener(10 ** 6, sums, np.eye(3), 2)
    plain = [sum((10 ** 6 * int(a) - s) ** 2 for a, s in zip(v, sums)) for v in x]
    assert model.deviation(x) == [min(p, 2 ** 63 - 1) for p in plain]


@pytest.mark.parametrize("kind", ["plain", "graded", "flat", "pairs", "close", "few", "repeated"])
def test_bidiagonal_solver(kind):
    random = np.random.default_rng(1)
    turn = np.linalg.qr(random.normal(size=(24, 24)))[0]
    scales = {"plain": np.linspace(1, 9, 24), "graded": 10.0 ** -np.arange(24), "flat": np.zeros(24), "pairs": np.repeat([5.0, 1], 12),
              "close": 1 + 1e-11 * np.arange(24), "few": np.r_[3.0, 2, np.zeros(22)], "repeated": np.ones(24)}[kind]
    matrix = scales[:, None] * turn.T if kind != "pairs" else np.diag(scales)
    values, axes = bidiagonal.directions(matrix, 6)
    expected = np.sort(scales ** 2)[::-1]
    assert np.allclose(values, expected, rtol=1e-12, atol=1e-13 * max(expected[0], 1))
    assert np.abs(axes.T @ axes - np.eye(6)).max() < 1e-11
    gram = matrix.T @ matrix
    assert np.abs(gram @ axes - axes * values[:6]).max() <= 1e-12 * max(expected[0], 1)
