"""Language identification: a linear-chain CRF labels the words of code-switched text by forward-backward."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.llm.bpe import ship
from bundlelens.llm.common import annotate, col, held as held_model
from bundlelens.llm.crf import Adam, packed, posteriors, transfer_of
from bundlelens.session import written

LONG_WORD = 24
WORDS = re.compile(r"[^\W\d_]{1,%d}" % LONG_WORD)
"""Words; a longer run of letters is cut into consecutive words, each labelled by the chain."""
SPACE = re.compile(r"\s")
UNKNOWN = "und"
BITS = 16
BUCKETS = 1 << BITS
BASE, SALT, MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
"""Odd numbers that hash the letters of a feature."""
SAMPLE_ROWS = 200
"""Labelled rows per language that the model is fitted on."""
SPARE = 4
SAMPLE_CHARS = 1_500
"""Characters of a sampled row, from a place in its text that depends on its hash."""
SPLICE = 25
"""Words after which the training chains switch to another sampled row, so that transitions are learned."""
STEPS = 30
LEXICON_COUNT = 4
WORDS_AT_ONCE = 100_000
LONG_TEXT = 1 << 20
"""Characters from which a text is labelled in stretches of about that size, cut at white space."""
WORDS_SCORED = 20_000
CACHE_WORDS = 200_000


def features(words) -> np.ndarray:
    """Hashed features of words in lower case, one row each: the word, its affixes of up to 4 letters, letter pairs and triples.

    Rows are as wide as the longest word needs; unused places hold bucket 0, which weighs nothing.
    """
    edged = np.array([f"^{w}$" for w in words])
    sizes = np.char.str_len(edged)
    letters = edged.view(np.uint32).reshape(len(edged), -1).astype(np.uint64)
    n, width = letters.shape
    columns = []

    def bucket(hashes, used=None):
        mixed = (hashes * MIX) >> np.uint64(64 - BITS)
        columns.append(mixed if used is None else np.where(used, mixed, np.uint64(0)))

    with np.errstate(over="ignore"):
        rolled, whole = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for i in range(width):
            whole = np.where(i < sizes, whole * BASE + letters[:, i], whole)
            if 1 <= i <= 4:
                rolled = rolled * BASE + letters[:, i]
                bucket(rolled + np.uint64(i) * SALT, i < sizes - 1)
        bucket(whole + np.uint64(9) * SALT)
        ends, rows = np.zeros(n, np.uint64), np.arange(n)
        for i in range(1, 5):
            ends = ends * BASE + letters[rows, np.maximum(sizes - 1 - i, 0)]
            bucket(ends + np.uint64(4 + i) * SALT, i < sizes - 1)
        for gram in (2, 3):
            hashes = letters[:, :width - gram + 1]
            for k in range(1, gram):
                hashes = hashes * BASE + letters[:, k:width - gram + 1 + k]
            used = np.arange(width - gram + 1) + gram <= sizes[:, None]
            for i in range(hashes.shape[1]):
                bucket(hashes[:, i] + np.uint64(8 + gram) * SALT, used[:, i])
    return np.stack([column.astype(np.int32) for column in columns], axis=1)


def _summed(weights, buckets) -> np.ndarray:
    """The sum of the weights of each row's features."""
    total = np.zeros((len(buckets), weights.shape[1]))
    for i in range(buckets.shape[1]):
        total += weights[buckets[:, i]]
    return total


def sample(docs: DataFrame, labelled, text: str, lang: str, key: str, rows: int, chars: int) -> DataFrame:
    """Up to ``rows`` labelled texts per language, of up to ``chars`` characters: (lang, text).

    The rows with the smallest hashes are taken. The labelled rows per language are counted first, which says below which
    hash ``SPARE`` times as many rows as needed are expected; only those are ranked, so what moves doesn't grow with the corpus.
    """
    order = F.xxhash64(col(key), F.lit(5))
    room = F.greatest(F.length(col(text)) - chars, F.lit(0)) + 1
    part = F.substring(col(text), (F.pmod(order, room) + 1).cast("int"), F.lit(chars))
    found = docs.filter(labelled & col(lang).isNotNull() & col(text).isNotNull())
    counts = written(found.groupBy(col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_rows")), "languages")
    share = F.lit(float(SPARE * rows)) / F.col("_rows")
    ranked = found.select(col(lang).alias("lang"), part.alias("text"), order.alias("_order")).join(
        counts, F.col("lang") == F.col("_lang")).filter((F.col("_order") / 2.0 ** 64 + 0.5) <= share)
    first = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "text")))
    return first.filter(F.col("_rank") <= rows).select("lang", "text")


def stretches(text: str):
    """Where the stretches of a long text begin and end: at white space, about ``LONG_TEXT`` characters each."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + LONG_TEXT)
        end = space.start() if space else len(text)
        yield at, end
        at = end


def fit(rows) -> bytes:
    """The model for (lang, text) rows, as a file. Word labels are those of their text.

    Texts are cut into short runs of words and dealt into chains that switch languages. The likelihood is maximised by
    gradient steps, whose expectations come from forward-backward.
    """
    texts = [(lang, [w for w in WORDS.findall(text.lower()) if any(map(str.isalpha, w))]) for lang, text in sorted(rows)]
    texts = [(lang, words) for lang, words in texts if words]
    labels = sorted({lang for lang, _ in texts})
    if not labels:
        return packed(labels=np.array([], "U1"))
    runs = [(labels.index(lang), words[i:i + SPLICE]) for lang, words in texts for i in range(0, len(words), SPLICE)]
    random = np.random.default_rng(11)
    order = random.permutation(len(runs))
    runs = [runs[i] for i in order]
    y = np.concatenate([np.full(len(words), label) for label, words in runs])
    words = [w for _, run in runs for w in run]
    per_chain = 8
    lengths = np.array([sum(len(r[1]) for r in runs[i:i + per_chain]) for i in range(0, len(runs), per_chain)])
    types = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.fromiter((types[w] for w in words), np.int64, len(words))
    names = list(types)
    buckets = features(names)
    used = buckets != 0
    flat, owner = buckets[used], np.nonzero(used)[0]
    counts = np.zeros((len(names), len(labels)))
    np.add.at(counts, (x, y), 1)
    lexicon = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * len(labels)))
    lexicon[counts.sum(axis=1) < LEXICON_COUNT] = 0

    n = len(labels)
    weights, transitions, trust = np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(1)
    step = Adam([weights, transitions, trust], 0.15)
    truth = np.zeros((len(x), n))
    truth[np.arange(len(x)), y] = 1
    joined = np.ones(len(x), bool)
    joined[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(joined)
    seen = np.zeros((n, n))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    for _ in range(STEPS):
        by_type = _summed(weights, buckets) + trust * lexicon
        expected, edges = posteriors(by_type[x], lengths, transitions, pairs=True)
        gap = np.stack([np.bincount(x, expected[:, k] - truth[:, k], len(names)) for k in range(n)], axis=1)
        spread = np.stack([np.bincount(flat, gap[owner, k], BUCKETS) for k in range(n)], axis=1)
        step([(spread / len(x) + 1e-6 * weights), (edges - seen) / len(x) + 1e-6 * transitions,
              np.array([(gap * lexicon).sum() / len(x)]) + 1e-4 * trust])
    kept = np.flatnonzero(counts.sum(axis=1) >= LEXICON_COUNT)
    return packed(labels=np.array(labels), weights=weights.astype("f4"), transitions=transitions,
                  words=np.array([names[i] for i in kept], dtype="U"), lexicon=(trust * lexicon[kept]).astype("f4"))


class Labeller:
    """Predicts languages with a fitted model; keeps the scores of words it has met."""

    def __init__(self, path: str):
        model = np.load(path)
        self.labels = model["labels"].tolist()
        if self.labels:
            self.weights, self.transitions = model["weights"], model["transitions"]
            self.lexicon = dict(zip(model["words"].tolist(), model["lexicon"]))
        self._clear()

    def _clear(self):
        self.types: dict[str, int] = {}
        self.new: list[str] = []
        self.table = np.zeros((0, len(self.labels)))

    def _index(self, words) -> np.ndarray:
        """The place of each word in the table of scores; words without a letter are left out."""
        types = self.types
        for w in [w for w in set(words) if w not in types]:
            if any(map(str.isalpha, w)):
                types[w] = len(self.table) + len(self.new)
                self.new.append(w)
            else:
                types[w] = -1
        index = np.fromiter(map(types.__getitem__, words), np.int64, len(words))
        return index[index >= 0]

    def _score(self):
        if self.new:
            parts = [self.table]
            for at in range(0, len(self.new), WORDS_SCORED):
                words = self.new[at:at + WORDS_SCORED]
                rows = _summed(self.weights, features(words))
                for i, w in enumerate(words):
                    if (more := self.lexicon.get(w)) is not None:
                        rows[i] += more
                parts.append(rows)
            self.table = np.concatenate(parts)
            self.new = []

    def _scores(self, text: str) -> np.ndarray:
        """The label scores of the words of a piece of text; scores of words kept from other pieces may go."""
        if len(self.types) > CACHE_WORDS:
            self._clear()
        index = self._index(WORDS.findall(text.lower()))
        self._score()
        return self.table[index]

    def _long(self, text: str):
        """(sums of the label probabilities, sum of the best ones, words) of one long chain, walked in stretches.

        The first walk gets each stretch's transfer matrix and so the states at the cuts; the second labels its words.
        """
        cuts, matrices, words = list(stretches(text)), [], 0
        for at, end in cuts:
            scores = self._scores(text[at:end])
            matrices.append(transfer_of(scores, self.transitions, not words) if len(scores) else None)
            words += len(scores)
        if not words:
            return None, 0.0, 0
        before, after = [None] * len(cuts), [None] * len(cuts)
        state = None
        for i, matrix in enumerate(matrices):
            before[i] = state
            if matrix is not None:
                state = (np.ones(len(matrix)) if state is None else state) @ matrix
                state = state / state.sum()
        state = np.ones(len(self.labels))
        for i in range(len(cuts) - 1, -1, -1):
            after[i] = state
            if matrices[i] is not None:
                state = matrices[i] @ state
                state = state / state.sum()
        sums, best = np.zeros(len(self.labels)), 0.0
        for (at, end), state, rest in zip(cuts, before, after):
            scores = self._scores(text[at:end])
            if len(scores):
                found = posteriors(scores, np.array([len(scores)]), self.transitions, before=state, after=rest)
                sums, best = sums + found.sum(axis=0), best + found.max(axis=1).sum()
        return sums, best, words

    def predict(self, texts) -> tuple[list[str], list[float], list[float]]:
        """The language of each text, its share of the label probabilities, and the mean of each word's best one."""
        names, scores, certain = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return names, scores, certain
        if len(self.types) > CACHE_WORDS:
            self._clear()
        held, which, total = [], [], 0

        def decide(i, line, best):
            at = int(line.argmax())
            names[i], scores[i], certain[i] = self.labels[at], min(1.0, float(line[at])), min(1.0, float(best))

        def flush():
            self._score()
            lengths = np.array([len(h) for h in held])
            found = posteriors(self.table[np.concatenate(held)], lengths, self.transitions)
            starts = np.cumsum(lengths) - lengths
            sums = np.add.reduceat(found, starts, axis=0) / lengths[:, None]
            for i, line, best in zip(which, sums, np.add.reduceat(found.max(axis=1), starts) / lengths):
                decide(i, line, best)

        long = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) > LONG_TEXT:
                long.append(i)
                continue
            index = self._index(WORDS.findall(text.lower()))
            if len(index):
                held.append(index)
                which.append(i)
                total += len(index)
            if total >= WORDS_AT_ONCE:
                flush()
                held, which, total = [], [], 0
        if held:
            flush()
        for i in long:
            sums, best, words = self._long(texts[i])
            if words:
                decide(i, sums / words, best / words)
        return names, scores, certain


def _labeller(name: str) -> Labeller:
    return held_model(name, lambda: Labeller(SparkFiles.get(name)))


def train(docs: DataFrame, labelled, text: str = "text", lang: str = "lang", key: str = "doc_id",
          rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> bytes:
    """Fits the model on a bounded sample of the rows that meet ``labelled``: ``rows`` per language of ``chars`` characters.

    The fit runs in one task over that sample; the driver gets the model file only.
    """
    def run(batches):
        learn = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array([fit(learn)], pa.binary())], names=["model"])

    found = sample(docs, labelled, text, lang, key, rows, chars).repartition(1).mapInArrow(run, "model binary").first()
    return bytes(found["model"]) if found else fit([])


def identify(docs: DataFrame, model: bytes, text: str = "text", carry=None) -> DataFrame:
    """Adds ``lang_pred``, ``score``, the mean probability of that language over the words, and ``certainty``, that of each word's best one.

    Every word of every text is labelled, whole texts as one chain each. The result depends on the text alone. Texts that
    are null, empty or without a letter give ``und`` and 0, as does a model without languages. No shuffle; a batch of words is
    bounded, and a longer text is labelled by itself in stretches that hand on the chain's state. Input columns named like a
    result give way to it.
    """
    name = ship(docs.sparkSession, model, "langid")

    def make():
        labeller = _labeller(name)
        return lambda texts: labeller.predict(texts)

    return annotate(docs, text, [("lang_pred", "string"), ("score", "double"), ("certainty", "double")], make, carry)
