"""The training-data operators: against brute force, and on nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from bundlelens.llm import bpe, exact_dedup, langid, lexicon, mixing, preference, quality, secrets, simhash, topk, url_filter
from bundlelens.llm.components import components
from bundlelens.llm.crf import posteriors

SPEC = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def docs(spark):
    long = "the quick brown fox jumps over the lazy dog " * 3000
    rows = [(1, "A b\tc", "en", "s", 5), (2, "Abc", "en", "s", 3), (3, None, None, None, None), (4, "", "en", "s", 0),
            (5, long, "en", "t", 1), (6, long + "x", "en", "t", 1), (7, "A b\tc", "fr", "s", 5), (7, "A b\tc", "fr", "s", 5),
            (None, "none has a key", None, "u", 1), (9, "été <|endoftext|> don't 12", "fr", None, 2), (10, "123 ...", "fr", "u", 7)]
    return spark.createDataFrame(rows, DOCS)


def by_brute_force(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com/en", "http://a.example.com/en/?q",
            "http://x.net/es/1", "http://net/fr/", "http://notexample.com/en/x", "http://x.org/" + "a/" * 5000, "http://x.net/es/1"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark)).collect()}
    assert len(got) == len(urls) and got[0] == got[2] == ("", None, "allow")
    assert got[4] == ("www.example.com", "www.example.com/en/", "allow") and got[5] == ("example.com", "com/", "allow")
    assert got[6][1:] == ("example.com/en/", "block") and got[7] == got[11] == ("x.net", "net/es/", "block")
    assert got[8][1] == "net/fr/" and got[9][1] == "com/" and got[10][1:] == (None, "allow")
    none = url_filter.rule_table(spark, [("com", "/", "block")]).filter("false")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.filter("false"), url_filter.rule_table(spark)).count() == 0


def test_exact_dedup_and_its_index(spark, docs, tmp_path):
    index = exact_dedup.open_index(spark, "index_of_test", path=str(tmp_path / "index"))
    got = exact_dedup.deduplicate(docs.withColumn("kept", docs.doc_id), index, "one").collect()
    kept = {(r["text_sha256"]): r["keep_id"] for r in got if r["kept"]}
    assert len(got) == 11 and len(kept) == sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert kept[hashlib.sha256(b"Abc").hexdigest()] == 1 and kept[hashlib.sha256(b"").hexdigest()] == 3
    again = exact_dedup.deduplicate(docs, index, "one").collect()
    assert sum(r["kept"] for r in again) == len(kept) and spark.table(index).count() == len(kept)
    assert not any(r["kept"] for r in exact_dedup.deduplicate(docs, index, "two").collect())
    assert exact_dedup.deduplicate(docs.filter("false"), index, "three").count() == 0


def test_simhash(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 11 and all(int(r["fingerprint"], 16) == by_brute_force(texts[r["doc_id"]]) for r in got)
    groups = {r["doc_id"]: r["component_id"] for r in got}
    assert groups[3] == groups[4] == 3 and groups[1] == groups[7] == 1 and groups[None] is None
    assert sum(r["kept"] for r in got) == len({(r["component_id"]) for r in got})
    assert simhash.near_duplicates(docs.filter("false")).count() == 0


def test_links_of_random_prints(spark):
    random = np.random.default_rng(3)
    seeds = random.integers(-2**62, 2**62, 40)
    prints = sorted({int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in random.integers(0, 62, (12, 2))} | {0, -1})
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), 2, rows=16)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    values, root = np.array(prints).view(np.uint64), list(range(len(prints)))
    changed = True
    near = [np.flatnonzero(np.bitwise_count(v ^ values) <= 2) for v in values]
    while changed:
        changed = False
        for i, js in enumerate(near):
            least = min(root[j] for j in js)
            changed |= least < root[i]
            root[i] = min(root[i], least)
    assert {p: got.get(p, p) for p in prints} == {p: prints[r] for p, r in zip(prints, root)}


def test_bpe(spark, docs):
    library = Tokenizer.from_file(SPEC)
    odd = ["İstanbul Ǆ ΣΑΣ", "a\x1cb\x00c", "é 한국어 ՘x 👍🏽", "x" * 3000, "'s's''re", " a b", "<|startoftext|><|endoftext|>"]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    for row in bpe.encode(more, SPEC, lexicon_words=5, decoded=True).collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids and row["n_tokens"] == len(ids)
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    encoded = bpe.encode(more, SPEC, lexicon_words=5)
    assert {r["decoded"] for r in bpe.decode(encoded, SPEC).collect()} == {
        r["decoded"] for r in bpe.encode(more, SPEC, lexicon_words=5, decoded=True).collect()}
    assert bpe.encode(more.filter("false"), SPEC).count() == 0


def test_lexicon(tmp_path):
    words = {w.encode(): np.array([len(w), i], "<u4").tobytes() for i, w in enumerate(["tap", "taps", "top", "tops", "été", "a"])}
    (tmp_path / "l").write_bytes(lexicon.compile_lexicon(words))
    found = lexicon.Lexicon(str(tmp_path / "l"))
    assert found.find(list(words)) == list(words.values()) and found.find([b"ta", b"tapss", b"", b"zz"]) == [None] * 4
    assert len(found.finals) < sum(map(len, words))


def test_mixing(spark):
    rows = [(i, "w " * (i % 90 + 1), None if i % 4 == 3 else f"s{i % 4}") for i in range(400)] + [(1000, None, "s0"), (1001, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", mixing.F.lit("old"))
    mixed = mixing.mix(docs, block_words=200, levels=3)
    got = mixed.collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, block_words=200, levels=3).collect()))
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(c["words"] for c in r["copies"]) for r in got)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and sum(r["size"] for r in own) == own[0]["source_size"]
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    clashing = docs.withColumns({"shard": mixing.F.lit(9), "copies": mixing.F.lit("x"), "a.b": mixing.F.lit(1), "_turn": mixing.F.lit(2)})
    out = mixing.mixed_documents(clashing, block_words=200, levels=3)
    lines = out.collect()
    assert out.columns == clashing.columns and {r["shard"] for r in lines} == {9} and out.rdd.getNumPartitions() == 8
    assert sum(len(r["text"].split()) for r in lines) == sum(r["taken"] for r in got)
    assert mixing.mix(docs.filter("false")).count() == 0 and mixing.mixed_documents(docs.filter("false")).count() == 0


def plain_targets(sizes, weights, share, repeats):
    """Targets by resharing the excess over the caps until none is left."""
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > repeats * sizes[i]}
        for i in over or open_:
            target[i] = repeats * sizes[i] if over else weights[i] * unit
        left -= sum(target[i] for i in over)
        open_ = open_ - over if over else set()
    return target


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 1000, 10, 0, 700, 3], [1], [0, 0], [10, 1, 1, 1, 1, 1, 1, 300]])
def test_targets_against_resharing(spark, sizes):
    table = spark.createDataFrame([(f"0s{i:02}", n) for i, n in enumerate(sizes)], "src string, source_size bigint")
    got = mixing.source_targets(table, (5, 2, 1), 1.5, 2).orderBy("place").collect()
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    assert np.allclose([r["target"] for r in got], plain_targets(sizes, weights, 1.5, 2))


def test_shards_follow_the_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    docs = spark.createDataFrame([(i, "w " * 20, f"s{i % 3}") for i in range(200)], "doc_id bigint, text string, source string")
    out = mixing.mixed_documents(docs, block_words=40)
    sizes = [sum(len(r["text"].split()) for r in part) for part in out.rdd.glom().collect()]
    assert len(sizes) == 16 and sum(sizes) == 6000 and 0.5 * 375 < min(sizes) and max(sizes) < 1.6 * 375


def test_tree_keeps_quotas(spark):
    leaves = mixing.split_tree(spark.createDataFrame([([7, 0, 1000, 31],)], "counts array<bigint>"), 4, 5).collect()
    counts = np.array([r["counts"] for r in leaves])
    assert len(leaves) == 16 and counts.sum(axis=0).tolist() == [7, 0, 1000, 31] and counts.min() >= 0
    assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "b"), (2, 0, None, None), (2, None, "user", "z")]
    other = [(1, 0, "user", "hi"), (1, 1, "assistant", "c"), (3, 0, "user", "alone")]
    kind = "conv_id bigint, turn bigint, role string, text string"
    rows = preference.format_preferences(spark.createDataFrame(turns, kind), spark.createDataFrame(other, kind)).collect()
    got = {r["conv_id"]: r for r in rows}
    assert got[1]["prompt"] == "<|user|>\nhi<|end|>\n" and got[1]["rejected"] == "<|assistant|>\nc<|end|>\n"
    assert got[1]["chosen_mask"] == "14:23" and got[1]["chosen"].endswith("<|user|>\nb<|end|>\n")
    assert got[3]["n_prompt"] == 0 and got[3]["chosen"] == "" and got[2]["rejected"] == ""


def test_preferences_of_turns_without_a_key(spark):
    kind = "conv_id bigint, turn bigint, role string, text string, prompt string"
    rows = [(None, 0, "user", "q", "x"), (None, 1, "assistant", "a", "x"), (None, 1, "assistant", "a", "x"), (0, 0, "user", "hi", "x"), (1, 0, "user", "yo", "x"),
            (None, None, None, None, "x")]
    turns = spark.createDataFrame(rows, kind)
    got = {r["conv_id"]: r for r in preference.format_preferences(turns, preference.swapped_endings(turns)).collect()}
    assert got[None]["n_prompt"] == 4 and got[None]["chosen"] == got[None]["rejected"] == ""
    assert got[0]["rejected"] == "<|user|>\nyo<|end|>\n" and got[1]["rejected"] == "<|user|>\nhi<|end|>\n" and len(got) == 3
    some = turns.filter("turn is not null").distinct()
    found = {r["conv_id"]: r for r in preference.format_preferences(some, preference.swapped_endings(some)).collect()}
    assert found[None]["chosen"].endswith("a<|end|>\n") and found[None]["rejected"] == "<|assistant|>\n<|end|>\n"
    empty = turns.filter("false")
    assert preference.format_preferences(empty, preference.swapped_endings(empty)).count() == 0


def test_top_k(spark):
    random = np.random.default_rng(5)
    rows = [(i % 95, [float(x) for x in v]) for i, v in enumerate(random.normal(size=(100, 8)))]
    rows += [(200, None), (201, [1.0, float("nan")] * 4), (202, [None] * 8), (None, [1.0] * 8), (250, [1e30] * 8), (300, [])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(vectors, mixing.F.col("vec_id") % 50 == 0, k=3, query_rows=2, shard_rows=16, fan_in=2).collect()
    whole = [(i, [int(np.floor(256 * x)) if abs(x) < 1e15 else int(256 * x) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (q, a) in enumerate(whole):
        if q % 50 == 0:
            scores = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for m, (i, b) in enumerate(whole) if m != n and len(a) == len(b))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:3])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_copies_no_tiles_to_the_driver(spark):
    vectors = spark.range(300).selectExpr("id as vec_id", "array(id / 300D, 1D) as embedding")
    asked = mixing.F.col("vec_id") % 50 == 0
    with_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        got = topk.top_k(vectors, asked, k=2, query_rows=1, shard_rows=10)
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect()))[-2:] == [(250, 1, 299, 65536 + 213 * 255), (250, 2, 298, 65536 + 213 * 254)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_limit)
    assert topk.blocks(156, 18, 50, 200) == (2, 100)  # not 18 copies of each vector and 156 of each query
    assert topk.blocks(3, 8, 50, 1000) == (8, 3) and topk.blocks(0, 0, 1, 8) == (1, 1)
    assert topk.blocks(10**4, 10**4, 1, 200)[0] == 10**4 / topk.HELD_TILES  # what a task holds stays bounded


def test_forward_backward_against_all_paths():
    from itertools import product
    random = np.random.default_rng(1)
    lengths, moves = np.array([3, 1, 70]), random.normal(size=(2, 2))
    scores = random.normal(size=(74, 2))
    got = posteriors(scores, lengths, moves)
    chances = {p: np.exp(sum(scores[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in product((0, 1), repeat=3)}
    first = sum(v for p, v in chances.items() if p[1] == 0) / sum(chances.values())
    assert abs(got[1, 0] - first) < 1e-9
    alpha, beta = [np.exp(scores[4])], [np.ones(2)]
    for t in range(5, 74):
        alpha.append((alpha[-1] @ np.exp(moves)) * np.exp(scores[t]))
        beta.insert(0, np.exp(moves) @ (np.exp(scores[78 - t]) * beta[0]))
    exact = np.array(alpha) * np.array(beta)
    assert np.allclose(got[4:], exact / exact.sum(axis=1, keepdims=True))


def test_language(spark, docs):
    learn = [("en", "the house and the garden of this man"), ("fr", "la maison et le jardin de cet homme")] * 20
    model = langid.fit(learn)
    texts = [(1, "the garden"), (2, "le jardin"), (3, None), (4, "12 ..."), (5, "the man et la maison de cet homme")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(texts, "doc_id int, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "fr", "und", "und", "fr"] and 0 < got[5]["score"] < 1
    none = langid.identify(docs, langid.fit([])).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == 11
    assert langid.identify(docs.filter("false"), model).count() == 0


def test_language_of_long_runs_and_many_languages(spark):
    rows = [("aa", "ana bana lana"), ("bb", "otto potto rotto")] * 20
    model = langid.fit(rows)
    run = "otto" * 3 + "ana" * 40 + "otto" * 3
    assert "".join(langid.WORDS.findall(run)) == run and max(map(len, langid.WORDS.findall(run))) == 24
    docs = spark.createDataFrame([(1, run)], "doc_id bigint, text string")
    assert langid.identify(docs, model).first()["lang_pred"] == "aa"
    many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(70)], "doc_id bigint, text string, lang string")
    assert langid.sample(many, langid.F.lit(True), "text", "lang", "doc_id", 5, 100).count() == 70


def test_language_of_long_texts_in_stretches(spark, monkeypatch):
    learn = [("en", "the house and the garden of this man"), ("fr", "la maison et le jardin de cet homme")] * 20
    model = spark.createDataFrame(learn, "lang string, text string").withColumn("doc_id", langid.F.monotonically_increasing_id())
    model = langid.train(model, langid.F.lit(True))
    random = np.random.default_rng(3)
    words = "the house garden la maison jardin of cet 12 ...".split()
    texts = [" ".join(random.choice(words, 300)), "12 " * 200 + "jardin", "12 " * 200, "the " * 100, "x" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    whole = sorted(map(tuple, langid.identify(docs, model, carry=["doc_id"]).collect()))
    path = str(langid.SparkFiles.getRootDirectory()) + "/" + langid.ship(spark, model, "langid")
    monkeypatch.setattr(langid, "LONG_TEXT", 64)
    monkeypatch.setattr(langid, "CACHE_WORDS", 3)
    names, scores, certain = langid.Labeller(path).predict(texts)
    for (_, name, score, certainty), *got in zip(whole, names, scores, certain):
        assert name == got[0] and np.allclose([score, certainty], got[1:], atol=1e-6)
    assert names[2] == "und" and 0.5 < certain[0] <= 1


def test_quality(spark, docs):
    good, bad = "a fine calm text number {} about trees", "you awful scum number {} about trees"
    texts = spark.createDataFrame([(i, (bad if i % 4 == 0 else good).format(i)) for i in range(400)], "doc_id bigint, text string")
    ratings = texts.filter("doc_id < 300").selectExpr("doc_id", "if(doc_id % 4 = 0, 0, 2) as grade")
    model = quality.train(texts, ratings.union(ratings))
    got = quality.rate(texts.filter("doc_id >= 300"), model).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 != 0) and 0 <= r["expected_grade"] <= 2 for r in got)
    assert quality.rate(docs, quality.train(docs, ratings.filter("false"))).count() == 11


def test_quality_of_long_tokens():
    tokens = quality.Tokens()
    clean, long = ",".join(["fine"] * 40), "山水" * 50
    toxic = quality._bucket("wvile")
    assert toxic in quality.features(f"{clean},vile", tokens) and toxic not in quality.features(clean, tokens)
    assert toxic in quality.features(f"{clean}_VILE", tokens)
    assert quality._bucket("g恶毒") in quality.features(f"{long}恶毒", tokens)
    assert quality.features(f"{clean},a", tokens) != quality.features(f"{clean},b", tokens)
    assert quality.features("a!!!!!?", tokens) != quality.features("a!!!!!!", tokens) and not any(len(t) > 64 for t in tokens)
    rows = [(0 if i % 2 else 2, np.array(quality.features(f"some {'vile' if i % 2 else 'kind'} words {i}", tokens))) for i in range(200)]
    import io
    model = np.load(io.BytesIO(quality.fit(rows)))
    score = lambda text: model["weights"][quality.features(text, quality.Tokens())].sum()
    assert score(f"{clean},vile") < score(f"{clean},other") < score(f"{clean},kind")


def test_secrets():
    import base64
    import zlib
    key = "AKIA" + "B" * 16
    assert secrets.find(None) == secrets.find("") == ([], [], 0)
    base, spans, _ = secrets.find(f"Token: 'abcdef1' {key} tokens=abc " + "0a" * 12 + " paſſword=abcdef")
    assert [(s[1]) for s in base] == [0, 1, 2] and base == [s[:3] for s in spans]
    token = base64.b64encode(zlib.compress(f"see %41KIA{'B' * 16} and password=hunter22".encode())).decode()
    text = f"x {token} y"
    _, spans, unread = secrets.find(text)
    assert {s[1] for s in spans} == {0, 1} and unread == 0
    assert all((s[0], s[2]) == (2, 2 + len(token)) for s in spans)
    _, spans, _ = secrets.find("é pass%77ord=hunter22")
    assert [s[:3] for s in spans] == [(2, 0, 21)]
    _, spans, _ = secrets.find("\\u0070assword=hunter22")
    assert [s[:3] for s in spans] == [(0, 0, 22)]
    assert secrets.find("%25" * 2000 + "41")[2] == 0


def test_secrets_in_many_and_long_layers(monkeypatch):
    import base64
    import zlib
    key = b"AKIA" + b"B" * 16
    tokens = [base64.b64encode(b"some text number %d" % i).decode() for i in range(10_500)]
    text = " ".join([*tokens, base64.b64encode(b"the key is " + key).decode()])
    _, spans, unread = secrets.find(text)
    assert [s[1] for s in spans] == [1] and spans[0][2] == len(text) and unread == 0
    line = "é, password=hunter22, ".encode()
    long = base64.b64encode(zlib.compress(b"x, " * 6_000_000 + line * 10 + key)).decode()  # 18 MB
    _, spans, unread = secrets.find(long)
    assert [s[:3] for s in spans if s[3]] == [(0, 0, len(long)), (0, 1, len(long))] and unread == 0
    for extra in range(3):  # a character lies across each place where chunks end
        half = base64.b64encode(zlib.compress(key + b" " * (extra + 1) + "é".encode() * (17 << 19))).decode()
        assert [s[1] for s in secrets.find(half)[1] if s[3]] == [1]
    monkeypatch.setattr(secrets, "MAX_RUN", 1 << 22)
    assert secrets.find(base64.b64encode(zlib.compress(b"z" * (9 << 20))).decode())[2] > 0


def test_secrets_under_several_encodings():
    import base64
    import gzip
    import zlib
    secret = b"password=hunter22 "

    def kinds(raw):
        token = base64.b64encode(raw).decode()
        return [s[1] for s in secrets.find(f"x {token} y")[1] if (s[0], s[2]) == (2, 2 + len(token))]

    assert kinds(gzip.compress(gzip.compress(secret))) == kinds(gzip.compress(zlib.compress(zlib.compress(secret)))) == [0]
    assert kinds(gzip.compress(b"first ") + gzip.compress(secret)) == [0]
    assert kinds(gzip.compress(gzip.compress(b"a") + gzip.compress(secret)) + b"AKIA" + b"B" * 16) == [0, 1]
    assert kinds(b"\x01\xff" + secret) == kinds(gzip.compress(b"\xff\x00" + secret)) == [0]
    assert kinds(gzip.compress(b"of a stream that ends early: " + secret)[:-9]) == [0]
    assert kinds(b"x^ no stream " + secret) == [0]
    _, spans, _ = secrets.find("%FF%70assword%3Dhunter22")
    assert [s[:3] for s in spans] == [(3, 0, 24)]
    _, spans, _ = secrets.find("%70%FFpass%77ord%3dhunter22")
    assert [s[:3] for s in spans] == [(6, 0, 27)]


def test_secrets_query_shape(spark, docs):
    got = secrets.with_digests(secrets.scan_documents(docs)).collect()
    assert len(got) == 11 and all(len(r["base_sha256"]) == 64 for r in got)
