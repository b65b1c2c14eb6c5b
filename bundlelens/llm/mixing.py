"""Mixing sources to target weights: exact block quotas, split among shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.llm.common import WORD, carried, col, word_count
from bundlelens.session import written

RESULTS = ("size", "source_size", "target", "taken", "copies")
BROADCAST_BLOCKS = 50_000
"""Blocks (some 100 bytes each) up to which the plan is broadcast to the documents."""
SHARD_WORDS = 1 << 23
"""Words (some 50 MB of text) that a shard may hold unless the number of shards is given."""
DEVIATIONS = 9
"""Standard deviations on either side of the mode that a draw may reach; what lies beyond is below 1e-17."""


def _uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) that depends on the seed and the parts only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return bits.cast("double") * F.lit(2.0 ** -53)


def hypergeometric(total, good, drawn, u) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``good`` ones, by inverting the distribution at ``u``.

    The probabilities follow from each other by their ratio, so only a window around the mode is
    walked: its width grows with the standard deviation, not with the counts.
    """
    n_total, n_good, n_drawn = (x.cast("double") for x in (total, good, drawn))
    low, high = F.greatest(F.lit(0).cast("bigint"), drawn + good - total), F.least(good, drawn)
    mode = F.floor((n_drawn + 1) * (n_good + 1) / (n_total + 2)).cast("bigint")
    variance = n_drawn * n_good * (n_total - n_good) * (n_total - n_drawn) / F.greatest(
        n_total * n_total * (n_total - 1), F.lit(1.0))
    reach = F.ceil(F.sqrt(F.greatest(variance, F.lit(0.0))) * DEVIATIONS).cast("bigint") + 9
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)

    def ratio(k):
        x = k.cast("double")
        return (n_good - x) * (n_drawn - x) / ((x + 1) * (n_total - n_good - n_drawn + x + 1))

    steps = F.sequence(first, last - 1)
    one = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"))

    def add(state, k):
        weight = state["weight"] * ratio(k)
        return F.struct(weight.alias("weight"), (state["sum"] + weight).alias("sum"))

    threshold = u * F.aggregate(steps, one, add, lambda s: s["sum"])
    start = F.struct(F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum"), F.lit(0).cast("bigint").alias("below"))

    def walk(state, k):
        weight = state["weight"] * ratio(k)
        return F.struct(weight.alias("weight"), (state["sum"] + weight).alias("sum"),
                        (state["below"] + (state["sum"] <= threshold).cast("bigint")).alias("below"))

    return F.when(last <= first, first).otherwise(
        first + F.aggregate(steps, start, walk, lambda s: s["below"]))


def split_counts(counts, drawn, seed: int, node) -> Column:
    """A multivariate-hypergeometric draw: how many of ``drawn`` items come from each of ``counts``."""
    size = F.size(counts)
    start = F.struct(
        F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), drawn.alias("drawn"),
        F.array().cast("array<bigint>").alias("taken"))

    def draw(state, i):
        good = F.element_at(counts, i)
        x = hypergeometric(state["total"], good, state["drawn"], _uniform(seed, node, i))
        return F.struct((state["total"] - good).alias("total"), (state["drawn"] - x).alias("drawn"),
                        F.concat(state["taken"], F.array(x)).alias("taken"))

    indexes = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(indexes, start, draw, lambda s: s["taken"])


def split_tree(root: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, counts) for ``2 ** levels`` shards from one row with the array ``counts``.

    Each node hands half of its blocks (the left child the odd one) to each child; which sources they come from is
    a multivariate-hypergeometric draw. Rows are split where they are, without a shuffle.
    """
    nodes = root.select(F.lit(0).cast("bigint").alias("shard"), "counts")
    for level in range(levels):
        total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
        half = F.floor((total + 1) / 2).cast("bigint")
        drawn = nodes.select("shard", "counts", split_counts(F.col("counts"), half, seed + level, F.col("shard")).alias("left"))
        halves = F.array("left", F.zip_with("counts", "left", lambda c, l: c - l))
        nodes = drawn.select("shard", F.posexplode(halves).alias("side", "counts")).select(
            (F.col("shard") * 2 + F.col("side")).alias("shard"), "counts")
    return nodes


def source_targets(sizes: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """Adds ``place`` (from 1), ``weight``, ``target`` to one row per source (``src``, ``source_size``).

    Sources in order of ``src`` get the weights in turn. Targets are proportional to the weights, stop
    at ``repeats`` times the source, and what is over goes to the others by weight: with the
    sources in the order in which they fill up, the common factor follows from running sums. The table has one
    row per source, so these windows pass one small table through a task.
    """
    ordered = sizes.withColumn("place", F.row_number().over(Window.orderBy("src"))).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size").cast("double") * repeats
    filling = Window.orderBy("_fill", "src")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = ordered.withColumn("_cap", cap).withColumn("_fill", F.col("_cap") / F.col("weight")).withColumn(
        "_factor", (F.sum(F.col("source_size").cast("double")).over(everything) * share
                    - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    factor = F.max(F.when(F.col("_factor") <= F.col("_fill"), F.col("_factor"))).over(everything)
    return running.withColumn("_common", factor).withColumn(
        "target", F.when(F.col("_common").isNull(), F.col("_cap")).otherwise(
            F.least("_cap", F.col("weight") * F.col("_common")))).drop("_cap", "_fill", "_factor", "_common")


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeats: int = 2, block_words: int = 1 << 16,
        levels: int | None = None, seed: int = 17, text: str = "text", source: str = "source", key: str = "doc_id",
        carry=None) -> DataFrame:
    """Decides how many words of each document the mix takes and into which of ``2 ** levels`` shards they go.

    Without ``levels`` there are as many shards as keep each below ``SHARD_WORDS`` words.

    Adds ``size`` (words), ``source_size``, ``target`` (of the source, in words), ``taken`` (words, repeats
    counted) and ``copies``, an array of (shard, words) with one entry per time the document is used;
    only one document per source is cut, where the source's target ends.

    The documents of a source are dealt into blocks of about ``block_words`` words by a hash of their
    key. The mix takes all blocks as often as the target holds the whole source, and of the rest a
    prefix of the permuted blocks. The numbers of blocks per source are the exact quotas that the
    tree splits among the shards; each shard then owns a range of the source's permuted draws, so shards are disjoint.
    Everything but the documents themselves is one row per block or per source.

    Null texts have size 0; null sources form one source, the last. Documents without words, and so whole
    sources of them, are taken 0. Rows that repeat a key are used alike. Null keys fall into one block.
    An empty table gives an empty one. Input columns named like a result give way to it.
    """
    return _mixed(docs, weights, share, repeats, block_words, levels, seed, text, source, key, carried(docs, carry, RESULTS))[0]


def _mixed(docs, weights, share, repeats, block_words, levels, seed, text, source, key, keep) -> tuple[DataFrame, int]:
    """The result of ``mix`` and its number of levels."""
    src = F.when(col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col(source).cast("string")))
    measured = docs.select(F.struct(*[col(c) for c in keep], F.lit(0).alias("_")).alias("row"), col(key).alias("id"),
                           src.alias("src"), word_count(col(text)).alias("size"))
    if text in keep:  # the texts are read again rather than stored
        rows = measured
        narrow = written(measured.select("id", "src", "size"), "sizes")
    else:
        rows = narrow = written(measured, "sizes")

    sizes = narrow.groupBy("src").agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(sizes, weights, share, repeats).select(
        "src", "place", "source_size", "target",
        F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("bigint").alias("n_blocks"),
        F.round("target").cast("bigint").alias("budget")), "sources")

    if levels is None:
        words = sources.agg(F.sum("budget")).first()[0] or 0
        levels = max(0, -(-words // SHARD_WORDS) - 1).bit_length()

    def in_blocks(table):
        of_source = sources.select(F.col("src").alias("_src"), "n_blocks")
        return table.join(of_source, F.col("src") == F.col("_src")).withColumn(
            "block", F.pmod(F.xxhash64("id", F.lit(seed)), "n_blocks")).drop("_src", "n_blocks")

    blocks = in_blocks(narrow).groupBy("src", "block").agg(F.sum("size").alias("words")).join(sources, "src")
    order = Window.partitionBy("src").orderBy(F.xxhash64("src", "block", F.lit(seed + 1)), "block")
    passes = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    remainder = F.when(F.col("source_size") > 0, F.expr("budget % source_size")).otherwise(F.lit(0))
    taken = written(blocks.withColumn("full", passes.cast("bigint")).withColumn(
        "part", F.greatest(F.lit(0).cast("bigint"), F.least("words", remainder - F.coalesce(
            F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    ).select("src", "block", "words", "place", "full", "part"), "blocks")

    plan = written(_with_shards(taken, sources, levels, seed), "plan")
    cut = _cut(in_blocks(narrow), plan, seed)

    # One row per block: counted, and broadcast while few; beyond that both sides are shuffled by block.
    by_block = plan.join(cut, (F.col("src") == F.col("_cut_src")) & (F.col("block") == F.col("_cut_block")), "left").select(
        F.col("src").alias("_src"), F.col("block").alias("_block"), "full", "part", "words", "shards",
        "_cut_at", "_cut_words", "_cut_taken")
    by_block = F.broadcast(by_block) if plan.count() <= BROADCAST_BLOCKS else by_block
    planned = in_blocks(rows).join(by_block,
        (F.col("src") == F.col("_src")) & (F.col("block") == F.col("_block"))).drop("_src", "_block").join(
        sources.select(F.col("src").alias("_src"), "source_size", "target"), F.col("src") == F.col("_src"))
    at = _cut_place(seed)
    partial = F.when((F.col("part") == F.col("words")) | (at < F.col("_cut_at")), F.col("size")).when(
        at == F.col("_cut_at"), F.expr("size * _cut_taken div _cut_words")).otherwise(F.lit(0)).cast("bigint")
    copies = F.filter(F.transform("shards", lambda s: F.struct(
        s["shard"].alias("shard"), F.when(s["turn"] < F.col("full"), F.col("size")).otherwise(partial).alias("words"))),
        lambda c: c["words"] > 0)
    return planned.select(
        *[F.col("row")[c].alias(c) for c in keep], "size", "source_size", "target",
        (F.col("size") * F.col("full") + partial).alias("taken"), copies.alias("copies")), levels


def _with_shards(taken: DataFrame, sources: DataFrame, levels: int, seed: int) -> DataFrame:
    """Adds ``shards``, an array of (turn, shard), to each block: one entry per time it is drawn."""
    turns = F.col("full") + (F.col("part") > 0).cast("bigint")
    draws = taken.filter(turns > 0).select(
        "src", "place", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), turns - 1)).alias("turn"))
    quotas = sources.select("src", "place").join(draws.groupBy("src").agg(F.count(F.lit(1)).alias("quota")), "src", "left")
    root = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("quota", F.lit(0)).alias("quota")))),
                                  lambda x: x["quota"]).alias("counts"))
    leaves = split_tree(root, levels, seed + 2).select("shard", F.posexplode("counts").alias("at", "quota"))
    ends = leaves.withColumn("end", F.sum("quota").over(Window.partitionBy("at").orderBy("shard"))).groupBy(
        (F.col("at") + 1).alias("_place")).agg(F.sort_array(F.collect_list("end")).alias("_ends"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(
        F.xxhash64("src", "block", "turn", F.lit(seed + 3)), "block", "turn"))
    dealt = draws.withColumn("_rank", rank).join(ends, F.col("place") == F.col("_place")).select(
        "src", "block", "turn", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).alias("shard"))
    # A block is drawn ``repeats`` times at most, so the list is short.
    lists = dealt.groupBy(F.col("src").alias("_src"), F.col("block").alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "shard"))).alias("shards"))
    return taken.join(lists, (F.col("src") == F.col("_src")) & (F.col("block") == F.col("_block")), "left").select(
        "src", "block", "words", "full", "part", F.coalesce("shards", F.expr("array()")).alias("shards"))


def _cut_place(seed: int) -> Column:
    """Where a key comes in a block that is taken in part."""
    return F.struct(F.xxhash64("id", F.lit(seed + 4)).alias("order"), F.col("id").alias("id"))


def _cut(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """For the one block per source that is taken in part: the key at which it ends, and the words taken of it.

    The keys before that place are taken whole and those behind it not at all, so one row per source says it all.
    """
    broken = plan.filter("part > 0 and part < words").select(F.col("src").alias("_src"), F.col("block").alias("_block"), "part")
    units = rows.filter("size > 0").join(broken, (F.col("src") == F.col("_src")) & (F.col("block") == F.col("_block"))).groupBy(
        "src", "block", "id", "part").agg(F.sum("size").alias("unit"))
    place = _cut_place(seed)
    order = Window.partitionBy("src").orderBy(place)
    before = F.coalesce(F.sum("unit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return units.withColumn("before", before).filter("before < part and before + unit >= part").select(
        F.col("src").alias("_cut_src"), F.col("block").alias("_cut_block"), place.alias("_cut_at"),
        F.col("unit").alias("_cut_words"), (F.col("part") - F.col("before")).alias("_cut_taken"))


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeats: int = 2, block_words: int = 1 << 16,
                    levels: int | None = None, seed: int = 17, text: str = "text", source: str = "source",
                    key: str = "doc_id") -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document once per copy, one partition per shard, shuffled within it.

    Decided as by ``mix``, whose parameters these are. A document that is cut keeps its first words, joined by single spaces.
    The number of shards follows from the words, so a task's share doesn't grow with the corpus. Rows go
    to the partition of their shard by its number, so no two shards share one.
    """
    names = docs.columns
    keep = [f"k{i}" for i in range(len(names))]
    plain = docs.select(*[col(name).alias(k) for name, k in zip(names, keep)])
    text, source, key = (keep[names.index(name)] for name in (text, source, key))
    mixed, levels = _mixed(plain, weights, share, repeats, block_words, levels, seed, text, source, key, keep)
    words = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), 0), 1, F.col("copy.words").cast("int")), " ")
    used = mixed.select(*keep, "size", F.posexplode("copies").alias("turn", "copy")).select(
        *[F.when(F.col("copy.words") < F.col("size"), words).otherwise(F.col(k)).alias(k) if k == text else k for k in keep],
        F.col("copy.shard").alias("shard"), "turn")
    order = F.xxhash64(*keep, "turn", F.lit(seed))
    dealt = used.repartitionById(2 ** levels, F.col("shard").cast("int")).sortWithinPartitions("shard", order)
    return dealt.select(*[F.col(k).alias(name) for k, name in zip(keep, names)])
