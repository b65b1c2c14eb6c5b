"""Operator 13 against a plain scan, and on nulls, short items, long texts, repeats, empty tables, clashing names."""

import hashlib
import re

import numpy as np
import pytest

from bundlelens.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_brute_force(text, items, width):
    words, hit, found = words_of(text), set(), set()
    for key, item in items:
        parts = words_of(item)
        size = min(width, len(parts))
        for at in range(len(parts) - size + 1 if parts else 0):
            for i in range(len(words) - size + 1):
                if words[i:i + size] == parts[at:at + size]:
                    hit.update(range(i, i + size))
                    found.add(key)
    names = sorted(str(k) for k in found if k is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.fixture
def tables(spark):
    random = np.random.default_rng(5)
    pick = lambda n, of=40: " ".join(random.choice([f"w{i}" for i in range(of)], n))
    items = [(i, pick(int(random.integers(1, 40)))) for i in range(60)]
    items += [(70, None), (71, ""), (72, "... --"), (73, "Solo"), (74, "été Ünï 12"), (None, "no key at all here"), (75, "a " * 30), (75, "second text of the same item"),
              (3, items[3][1]), (76, items[3][1]), (77, pick(2000, 400)), (78, "x y"), (79, "x y z")]
    docs = [pick(int(random.integers(0, 80))) for _ in range(30)]
    for _, item in items[:60:3]:
        words = item.split()
        docs.append(pick(7) + ", " + " -- ".join(words).upper() + "! " + pick(5))
        docs.append(" ".join(words[1:]) + " " + " ".join(words[:-1]))
    docs += [None, "", "...", "solo", "SOLO solo", "Été ünï 12, été Ünï 12", "No key, at all: here", "a " * 500, "x y x y z x", "x\x00y\x7fz",
             items[-3][1], pick(5000) + " " + items[-3][1][300:900], "a" * 3_000_000 + " x y", docs[30], docs[30]]
    documents = spark.createDataFrame([(i, t, "old", [1], i) for i, t in enumerate(docs)],
                                      "doc_id int, text string, n_hit string, spans array<int>, row int").repartition(3)
    return documents, docs, spark.createDataFrame(items, "item_id bigint, text string"), items


@pytest.mark.parametrize("width, block", [(10, decontamination.BLOCK_BYTES), (10, 3000), (4, decontamination.BLOCK_BYTES)])
def test_against_a_plain_scan(spark, tables, monkeypatch, width, block):
    monkeypatch.setattr(decontamination, "CHUNK", 128)
    documents, docs, benchmark, items = tables
    found = decontamination.find_benchmark(documents, benchmark, width, block_bytes=block)
    assert found.columns == ["doc_id", "text", "spans", "row", *RESULTS]
    got = {r["doc_id"]: tuple(r[c] for c in RESULTS) for r in found.drop("text").collect()}
    assert len(got) == len(docs)
    short = [i for i in range(len(docs)) if len(docs[i] or "") < 100_000]
    assert {i: got[i] for i in short} == {i: by_brute_force(docs[i], items, width) for i in short}
    long = next(i for i in range(len(docs)) if i not in short)
    assert got[long][:3] == (3, 2, 1)


def test_empty_tables(spark, tables):
    documents, docs, benchmark, _ = tables
    assert decontamination.find_benchmark(documents.filter("false"), benchmark).count() == 0
    clean = decontamination.find_benchmark(documents, benchmark.filter("false"), carry=["doc_id"])
    assert {(r["n_hit"], r["n_items"], r["contaminated"]) for r in clean.collect()} == {(0, 0, False)} and clean.count() == len(docs)


def test_shift_tables_skip():
    random = np.random.default_rng(1)
    windows = random.integers(1, 1000, (50, 10)).astype("<i4")
    table = decontamination.Class(windows)
    text = random.integers(1000, 2000, 4000).astype("<i4")
    text[100:110], text[395:405] = windows[3], windows[9]
    found = sorted((int(p), int(w)) for places, which in table.search(text) for p, w in zip(places, which))
    assert found == [(100, 3), (395, 9)] and (table.shift == 9).mean() > 0.8
