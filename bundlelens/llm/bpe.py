"""BPE encoding and decoding with a lexicon of the corpus's frequent words."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.llm.common import annotate, col, held
from bundlelens.llm.lexicon import Lexicon, compile_lexicon
from bundlelens.session import written

LEXICON_WORDS = 100_000
CACHE_WORDS = 50_000
"""Chunks of text whose ids a worker keeps; then it starts afresh."""
SHORT_WORD = 48
"""Bytes up to which a scan of all pairs is the faster way to merge a word."""
WORDS_AT_ONCE = 2048
"""Words that are looked up or merged side by side; the arrays for them take a few MB."""
LONG_CHUNK = 256
"""Longer chunks are encoded each time rather than kept."""
FIRST_UNSURE = 0x250
"""From this code point on, the tokenizer's own normaliser and splitter decide what a letter is (Unicode versions differ)."""
WHITE = regex.compile(r"\p{White_Space}+")
PYTHON_ONLY_SPACE = "\x1c\x1d\x1e\x1f"
"""What str.split takes for white space though Unicode's property doesn't."""


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class PairTable:
    """Ranks of pairs of ids and what they merge to, found by hash for whole arrays of pairs."""

    def __init__(self, merges):
        left, right, result = (np.array(x, np.int64) for x in zip(*merges))
        self.never = len(merges)
        keys = left << 20 | right
        self.bits = max(4, int(len(merges)).bit_length() + 1)
        self.steps = 1
        home = self._home(keys)
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size + 1, self.never, np.int64)
        self.result = np.full(size + 1, -1, np.int64)
        for rank, (key, slot) in enumerate(zip(keys.tolist(), home.tolist())):
            tried = 1
            while self.key[slot] >= 0:
                slot, tried = (slot + 1) % size, tried + 1
            self.key[slot], self.rank[slot], self.result[slot] = key, rank, result[rank]
            self.steps = max(self.steps, tried)

    def _home(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, left, right) -> np.ndarray:
        """The slot of each pair; the last, empty one for pairs that don't merge (an id of -1 merges with nothing)."""
        keys = (left << 20 | right).ravel()
        found = np.full(len(keys), len(self.key))
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slot = self._home(keys[open_])
        for _ in range(self.steps):
            held = self.key[slot]
            hit = held == keys[open_]
            found[open_[hit]] = slot[hit]
            on = ~hit & (held >= 0)
            open_, slot = open_[on], (slot[on] + 1) & (len(self.key) - 1)
            if not len(open_):
                break
        return found.reshape(left.shape)


class WordTokenizer:
    """Encodes and decodes texts exactly as the tokenizer file says: lower-case words with word ends.

    Fits files whose model is BPE with a word-end suffix over byte characters, without a decoder (the
    tokens are joined by spaces). Others raise ValueError.
    """

    def __init__(self, spec: str, lexicon: Lexicon | None = None):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or parsed["decoder"]:
            raise ValueError("not a BPE file with word ends")
        self.suffix, self.vocab = model["end_of_word_suffix"], model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(pairs)}
        added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        self.tokens = {i: t for t, i in [*self.vocab.items(), *added.items()]}
        splitter = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.splitter = regex.compile(splitter)
        self.alphabet = byte_alphabet()
        bare = Tokenizer.from_str(json.dumps(parsed | {
            "added_tokens": [], "model": model | {"vocab": {}, "merges": []},
            "pre_tokenizer": parsed["pre_tokenizer"]["pretokenizers"][0]}))
        self.normalizer, self.pre_tokenizer = bare.normalizer, bare.pre_tokenizer
        self.lexicon = lexicon
        self.chunks: dict = {}
        self.letter_ids = np.array([self.vocab.get(c, -1) for c in self.alphabet])
        self.last_ids = np.array([self.vocab.get(c + self.suffix, -1) for c in self.alphabet])
        if min(self.letter_ids.min(), self.last_ids.min()) < 0:
            raise ValueError("the vocabulary lacks some byte")
        self.pairs = PairTable([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in self.ranks])

    def words(self, chunk: str) -> list[str]:
        """The words of a piece of text without white space."""
        if max(chunk) < chr(FIRST_UNSURE):
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if chunk[-1] in ".,;:!?" and low[:-1].isalpha():
                return [low[:-1], chunk[-1]]
            return self.splitter.findall(low)  # every text below that point is composed already
        return [word for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def merge(self, word: str) -> list[int]:
        """The ids of a word by applying its merges in the order of their ranks, the leftmost of equal ones first."""
        parts = [self.alphabet[b] for b in word.encode()]
        parts[-1] += self.suffix
        return self._merge_long(parts) if len(parts) > SHORT_WORD else self._merge_short(parts)

    def _merge_short(self, parts: list[str]) -> list[int]:
        rank, never = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), never)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), never)
        return [self.vocab[p] for p in parts]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """Candidates wait in a heap and parts in a linked list, so a long word takes n log n steps."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (rank, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (rank, h, parts[h], parts[i]))
        return [self.vocab[p] for p in parts if p]

    def _merge_many(self, words: list[str]) -> list[bytes]:
        """The ids of words of up to ``SHORT_WORD`` bytes, merged side by side: one merge per word and round."""
        out: list = [b""] * len(words)
        data = [w.encode() for w in words]
        groups = ([i for i, d in enumerate(data) if width - 8 < len(d) <= width] for width in range(8, SHORT_WORD + 1, 8))
        for chosen in (group[at:at + WORDS_AT_ONCE] for group in groups for at in range(0, len(group), WORDS_AT_ONCE)):
            width = -(-max(len(data[i]) for i in chosen) // 8) * 8
            sizes = np.fromiter((len(data[i]) for i in chosen), np.int64, len(chosen))
            letters = np.array([data[i] for i in chosen], f"S{width}").view(np.uint8).reshape(len(chosen), width)
            parts = np.where(np.arange(width) < sizes[:, None], self.letter_ids[letters], -1)
            rows = np.arange(len(chosen))
            parts[rows, sizes - 1] = self.last_ids[letters[rows, sizes - 1]]
            done = parts.copy()
            active = rows
            while len(active):
                slots = self.pairs.slots(parts[:, :-1], parts[:, 1:])
                ranks = self.pairs.rank[slots]
                at = ranks.argmin(axis=1)
                best = np.arange(len(active))
                merged = ranks[best, at] < self.pairs.never
                done[active[~merged]] = parts[~merged]
                active, parts, at, slots = active[merged], parts[merged], at[merged], slots[merged]
                if not len(active):
                    break
                best = np.arange(len(active))
                parts[best, at] = self.pairs.result[slots[best, at]]
                take = np.arange(width) + (np.arange(width) > at[:, None])
                parts = np.concatenate([parts, np.full((len(parts), 1), -1)], axis=1)[best[:, None], take]
            counts = (done >= 0).sum(axis=1)
            packed = done.astype("<u4")
            for i, row, n in zip(chosen, packed, counts.tolist()):
                out[i] = row[:n].tobytes()
        return out

    def _known(self, words: list[str]) -> list[bytes | None]:
        return self.lexicon.find([w.encode() for w in words]) if self.lexicon else [None] * len(words)

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks: words of the lexicon from the transducer, others by merging.

        Chunks of lexicon words are kept for later texts; the others are mostly met once.
        """
        words = [self.words(chunk) for chunk in chunks]
        distinct = list({w for ws in words for w in ws})
        known = [k for at in range(0, len(distinct), WORDS_AT_ONCE) for k in self._known(distinct[at:at + WORDS_AT_ONCE])]
        ids = {w: k for w, k in zip(distinct, known) if k is not None}
        unseen = [w for w, k in zip(distinct, known) if k is None]
        short = [w for w in unseen if len(w.encode()) <= SHORT_WORD and "\0" not in w]
        frequent = set(ids)
        ids.update(zip(short, self._merge_many(short)))
        for w in unseen:
            if w not in ids:
                ids[w] = array("I", self.merge(w)).tobytes()
        found = {c: ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for c, ws in zip(chunks, words)}
        keep = {c: found[c] for c, ws in zip(chunks, words) if len(c) <= LONG_CHUNK and frequent.issuperset(ws)}
        if len(self.chunks) + len(keep) > CACHE_WORDS:
            self.chunks.clear()
        self.chunks.update(keep)
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        return self.encode_all([text])[0]

    def _plain(self, text: str) -> list[str]:
        return list(filter(None, WHITE.split(text))) if any(c in text for c in PYTHON_ONLY_SPACE) else text.split()

    def encode_all(self, texts) -> list[bytes]:
        """The ids of each text. Chunks that are new are learnt together, then the texts are put together from chunks."""
        split, special, chunks = [], {i: array("I", [i]).tobytes() for i in self.added.values()}, set()
        for text in texts:
            if text and self.special and any(token in text for token in self.added):
                parts = [[self.added[p]] if p in self.added else self._plain(p) for p in self.special.split(text)]
                split.append([c for part in parts for c in part])
            else:
                split.append(self._plain(text) if text else [])
            chunks.update(split[-1])
        ids = {c: k for c in chunks if (k := self.chunks.get(c)) is not None} | special
        ids.update(self.learn(list(chunks - ids.keys())))
        return [b"".join(map(ids.__getitem__, one)) for one in split]

    def decode(self, ids: bytes) -> str:
        """The tokens of packed ids, joined by single spaces; ids beyond the vocabulary are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in array("I", ids) if i in tokens])


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) over all texts: what white space separates, in lower case."""
    words = docs.select(F.explode(F.split(F.lower(col(text)), r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def frequent_words(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(word): the words of all texts that are seen at least ``c`` times, for the smallest ``c`` > 1 that gives ``size`` or fewer.

    How many words are seen how often is counted on the executors; the driver gets that table of
    distinct counts (a few thousand rows) and nothing of the words.
    """
    counts = written(word_counts(docs, text).filter((F.col("count") > 1) & (F.length("word") <= LONG_CHUNK)), "word_counts")
    histogram = counts.groupBy("count").agg(F.count(F.lit(1)).alias("words"))
    running = F.sum("words").over(Window.orderBy(F.desc("count")))
    least = histogram.withColumn("_running", running).filter(F.col("_running") <= size).agg(F.min("count")).first()[0]
    return counts.filter(F.col("count") >= least if least else F.lit(False)).select("word")


def build_lexicon(docs: DataFrame, spec_name: str, size: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """The transducer of the up to ``size`` most frequent words of all texts, for the shipped tokenizer file.

    It speeds encoding up and never changes its result. It is built in one task over those words; the driver gets the file.
    """
    def run(batches):
        with open(SparkFiles.get(spec_name), encoding="utf-8") as file:
            tokenizer = WordTokenizer(file.read())
        words = {word for batch in batches for chunk in batch.column(0).to_pylist() for word in tokenizer.words(chunk)}
        built = compile_lexicon({word.encode(): ids for word, ids in tokenizer.learn(sorted(words)).items()})
        yield pa.RecordBatch.from_arrays([pa.array([built], pa.binary())], names=["lexicon"])

    found = frequent_words(docs, size, text).repartition(1).mapInArrow(run, "lexicon binary").first()
    return bytes(found["lexicon"]) if found else compile_lexicon({})


def ship(spark: SparkSession, content: bytes, label: str) -> str:
    """Gives every executor a file of its own with this content; returns its name.

    The name follows from the content, so shipping it again does nothing. Spark fetches it anew for executors that replace lost ones.
    """
    name = f"{label}-{hashlib.sha256(content).hexdigest()[:24]}"
    root = os.path.join(SparkFiles.getRootDirectory(), "shipped")
    path = os.path.join(root, name)
    if not os.path.exists(path):
        os.makedirs(root, exist_ok=True)
        with open(path, "wb") as file:
            file.write(content)
        spark.sparkContext.addFile(path)
    return name


def _tokenizer(spec_name: str, lexicon_name: str) -> WordTokenizer:
    def build():
        with open(SparkFiles.get(spec_name), encoding="utf-8") as file:
            return WordTokenizer(file.read(), Lexicon(SparkFiles.get(lexicon_name)))
    return held((spec_name, lexicon_name), build)


def encode(docs: DataFrame, spec_path: str, text: str = "text", lexicon_words: int = LEXICON_WORDS, decoded: bool = False,
           carry=None) -> DataFrame:
    """Adds ``ids`` (little-endian unsigned 32-bit numbers, packed) and ``n_tokens``; with ``decoded`` also the decoded text.

    The ids are those of the tokenizers library for the file at ``spec_path`` on the driver (no special tokens
    are added, those in a text are found). A word of the lexicon is looked up in the mapped transducer, any other is merged
    exactly. Texts are encoded whole, in bounded batches, where they lie: the only shuffle is that of
    the word counts.

    Null and empty texts give no ids and, decoded, the empty text. Texts of any length are fine. An empty table gives an
    empty one. Input columns named like a result give way to it.
    """
    spark = docs.sparkSession
    with open(spec_path, encoding="utf-8") as file:
        spec = file.read()
    spec_name = ship(spark, spec.encode(), "tokenizer")
    names = spec_name, ship(spark, build_lexicon(docs, spec_name, lexicon_words, text), "lexicon")
    fields = [("ids", "binary"), ("n_tokens", "bigint")] + [("decoded", "string")] * decoded

    def make():
        tokenizer = _tokenizer(*names)

        def step(texts):
            ids = tokenizer.encode_all(texts)
            out = [ids, [len(i) // 4 for i in ids]]
            return out + [[tokenizer.decode(i) for i in ids]] if decoded else out
        return step

    return annotate(docs, text, fields, make, carry)


def decode(encoded: DataFrame, spec_path: str, ids: str = "ids", carry=None) -> DataFrame:
    """Adds ``decoded``, the text of packed ids. Null ids give the empty text."""
    spark = encoded.sparkSession
    with open(spec_path, encoding="utf-8") as file:
        spec = file.read()
    names = ship(spark, spec.encode(), "tokenizer"), ship(spark, compile_lexicon({}), "lexicon")

    def make():
        tokenizer = _tokenizer(*names)
        return lambda packed: [[tokenizer.decode(i) if i else "" for i in packed]]

    return annotate(encoded, ids, [("decoded", "string")], make, carry)
