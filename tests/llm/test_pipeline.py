"""The corpus pipeline: each stage against a plain version on the stage before, and as a whole."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from bundlelens.session import written

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")


def prints(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    after = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = after[name] = written(stage(spark, docs, SF_DIR), name)
    rows = {name: df.collect() for name, df in after.items()}
    assert all(df.columns == after[""].columns for name, df in after.items() if name != "bpe")

    ids = {r["doc_id"] for r in rows["language_id"]}
    gone = [r["text"] for r in rows[""] if r["doc_id"] not in ids]
    assert ids <= {r["doc_id"] for r in rows[""]} and len(gone) < 0.1 * len(rows[""])

    best = {}
    for r in rows["language_id"]:
        digest = SPACE.sub("", r["text"] or "")
        best[digest] = min(best.get(digest, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert {r["doc_id"] for r in rows["exact_dedup"]} == {key for _, key in best.values()}

    left = sorted((r["doc_id"], prints(r["text"])) for r in rows["exact_dedup"])
    values, root = np.array([p for _, p in left], np.uint64), list(range(len(left)))
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(v ^ values) <= 2).tolist():
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert {r["doc_id"] for r in rows["simhash_dedup"]} == {left[r][0] for r in set(root)}

    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows["simhash_dedup"]}
    uses = Counter(r["doc_id"] for r in rows["mixing"])
    taken = sum(len(WORD.findall(r["text"])) for r in rows["mixing"])
    assert set(uses) <= set(size) and max(uses.values()) <= 2 and abs(taken - 1.5 * sum(size.values())) <= 0.01 * sum(size.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain = Counter()
    for r in rows["mixing"]:
        found = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(found, skip_special_tokens=False)
        plain[r["doc_id"], r["lang"], r["source"], len(found), np.array(found, "<u4").tobytes(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((*r[:4], bytes(r[4]), r[5]) for r in rows["bpe"]) == plain
    assert Counter((*r[:4], bytes(r[4]), r[5]) for r in corpus_pipeline.run(spark, SF_DIR).collect()) == plain


def test_stages_on_odd_tables(spark):
    """Clashing and dotted names come back untouched; nulls, empty texts, repeated rows and an empty table pass."""
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept int, `a.b` int, _file string, target int"
    words = [f"w{i}" for i in range(200)]
    near = [w if i != 70 else "other" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(near), " ".join(words), None, "", "plain words of a short text", "plain words  of a short text", "12"]
    rows = [(i if i != 5 else None, t, "en", "s" if i % 2 else None, 1, "kept?", 7, 8, "f", 9) for i, t in enumerate(texts)] * 2
    table = spark.createDataFrame(rows, kind)
    for docs in (table, table.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, ""), name)
            assert docs.columns == table.columns
            assert {(r["score"], r["kept"], r["a.b"], r["_file"], r["target"]) for r in docs.collect()} <= {("kept?", 7, 8, "f", 9)}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    stages = dict(corpus_pipeline.STAGES)
    once = stages["exact_dedup"](spark, table, "").collect()
    assert sorted(str(r["doc_id"]) for r in once) == ["0", "1", "3", "6", "7"]
    links = [prints(a) ^ prints(b) for a, b in [(texts[0], texts[1])]]
    assert len(stages["simhash_dedup"](spark, table, "").collect()) == 4 + (links[0].bit_count() > 2)
