"""Mixing sources to target shares of the tokens.

1. *Blocks.* Each distinct text of a listed source is encoded once and belongs to
   the document with the smallest doc_id that has it. A source's texts are ordered
   by a hash of their doc_id, whatever files they lie in, and packed into blocks of
   ``block`` tokens (its last one may be shorter). Offsets are prefix sums in two
   levels, over buckets of hashes of about ``BUCKET`` tokens and within them, so
   that no task sees a whole source.
2. *Slots.* The mix has as many block slots as the scarcest source allows when its
   blocks are repeated up to its cap. Each output shard draws its source counts:
   multinomial, given that the counts of all shards add up to the targets. A shard
   finds its counts alone, by walking down a binary tree of seeded draws.
3. *Index permutations.* Slot j of a source takes block j mod b of a keyed
   permutation of its b blocks, a new permutation for each round; so no block, and
   no text, occurs more often than the cap.
4. *Join.* Slots meet the index of blocks, which says in which buckets a block
   lies, and with that the texts of those buckets. The ids are shuffled once, to
   their bucket; only the parts of slots whose block lies across two buckets are
   brought together after that.

Defined cases: null and empty texts have no tokens; sources that are not listed,
and null, take no part; a listed source without tokens or share gets nothing and
the others keep their ratios; an empty table gives an empty mix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .encode import token_ids

BLOCK, SHARD, BUCKET, SEED = 128, 512, 1 << 20, 41
TURNS = 8
PART = "shard BIGINT, slot BIGINT, source STRING, block BIGINT, repeat BIGINT, start BIGINT, whole BOOLEAN, ids ARRAY<INT>"


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed bijection of range(size): a Feistel network, walked until it is in range."""
    if size < 2:
        return index
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = x[todo] >> np.uint64(half), x[todo] & mask
            for turn in range(4):
                h = (right + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((h >> np.uint64(32)) & mask)
            x[todo] = (left << np.uint64(half)) | right
            todo = x >= np.uint64(size)
    return x.astype(np.int64)


def shard_counts(shard: int, totals: np.ndarray, slots: int, seed: int = SEED, size: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(counts, counts before) of a shard for each source."""
    low, high, before, held, node = 0, -(-slots // size), np.zeros_like(totals), totals.copy(), 1
    while high - low > 1:
        middle = (low + high) // 2
        left_slots = (middle - low) * size
        draw = np.random.default_rng([seed, node]).multivariate_hypergeometric(held, min(left_slots, int(held.sum())), method="marginals")
        if shard < middle:
            held, high, node = draw, middle, 2 * node
        else:
            before, held, low, node = before + draw, held - draw, middle, 2 * node + 1
    return held, before


def plan(stats: pd.DataFrame, block: int = BLOCK) -> tuple[pd.DataFrame, int]:
    """Slots per source from (source, target_share, max_repeats, tokens), one row
    a listed source."""
    stats = stats.sort_values("source").reset_index(drop=True)
    able = (stats["tokens"] > 0) & (stats["target_share"] > 0) & (stats["max_repeats"] > 0)
    share = np.where(able, stats["target_share"], 0.0)
    share = share / share.sum() if share.sum() else share
    stats["blocks"] = -(-stats["tokens"] // block)
    if not able.any():
        return stats.assign(slots=0), 0
    room = stats["tokens"][able] * stats["max_repeats"][able] / block / share[able]
    slots = int(np.floor(room.min() + 1e-9))
    exact = share * slots
    count = np.floor(exact).astype(np.int64)
    for i in np.argsort(count - exact, kind="stable")[: slots - int(count.sum())]:
        count[i] += 1
    return stats.assign(slots=np.minimum(count, stats["blocks"] * stats["max_repeats"])), int(np.minimum(count, stats["blocks"] * stats["max_repeats"]).sum())


def encoded_sources(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(encoded, copies, lengths): the ids of all texts of the listed sources, the
    (doc_id, source) of those that repeat another's text, and (doc_id, source, n), the
    number of tokens of the others. All are written once; the texts are never shuffled
    to find copies, only their hashes are."""
    listed = targets.where(F.col("source").isNotNull()).select("source").distinct()
    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "source").join(F.broadcast(listed), "source")
    named = texts.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.hash("text", F.lit(3)).alias("h2"), F.length("text").alias("n"))
    first = named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    copies = settled(lambda: named.join(first, ["h1", "h2", "n"]).where(F.col("doc_id") != F.col("first")).select("doc_id", "source"))
    encoded = settled(lambda: token_ids(texts, keep=("source",)))
    lengths = encoded.select("doc_id", "source", F.size("ids").alias("n")).join(copies.select("doc_id"), "doc_id", "left_anti")
    return encoded, copies, settled(lambda: lengths)


def _fill(block: int):
    """The slots of a bucket with the ids of their blocks, or the part of these that
    lies in the bucket; rows with a ``copy`` name the texts that are left out. A bucket
    has a bounded number of tokens, and meets ``TURNS`` repetitions of its blocks at
    most."""

    def fill(texts: pa.Table, slots: pa.Table) -> pa.Table:
        kept = ["shard", "slot", "source", "block", "repeat"]
        dropped = slots["copy"].drop_null().to_numpy()
        slots = slots.filter(slots["copy"].is_null())
        if slots.num_rows:
            texts = texts.filter(pa.array(~np.isin(texts["doc_id"].to_numpy(), dropped)))
        ahead = slots["ahead"][0].as_py() if slots.num_rows else 0
        order = np.lexsort((texts["doc_id"].to_numpy(), texts["h"].to_numpy()))
        ids = texts["ids"].combine_chunks().take(pa.array(order)).flatten().to_numpy() if slots.num_rows else np.zeros(0, dtype=np.int32)
        number = slots["block"].to_numpy() if slots.num_rows else np.zeros(0, dtype=np.int64)
        low = np.maximum(number * block - ahead, 0)
        size = np.minimum((number + 1) * block - ahead, len(ids)) - low
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = ids[np.repeat(low - ends[:-1], size) + np.arange(ends[-1])]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
        return pa.table({**{c: slots[c] for c in kept}, "start": ahead + low, "whole": size == block, "ids": lists})

    return fill


def filled(drawn: DataFrame, encoded: DataFrame, copies: DataFrame, lengths: DataFrame, tokens: dict[str, int], turns: dict[str, int], block: int = BLOCK) -> DataFrame:
    """(shard, slot, source, block, repeat, ids) of ``drawn`` slots. ``tokens`` gives
    the number of a source's buckets, ``turns`` how often its blocks may occur: a
    bucket that occurs more than ``TURNS`` times is read by several tasks."""
    spark = encoded.sparkSession
    known = spark.createDataFrame([(s, max(1, n // BUCKET), -(-turns.get(s, 1) // TURNS)) for s, n in tokens.items()], "source STRING, buckets BIGINT, groups BIGINT")
    def bucketed(df: DataFrame) -> DataFrame:
        placed = df.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(known), "source")
        return placed.withColumn("bucket", F.pmod("h", "buckets"))

    texts = bucketed(encoded.where(F.size("ids") > 0)).select("doc_id", "source", "h", "bucket", "groups", "ids")
    sums = bucketed(lengths.where("n > 0")).groupBy("source", "bucket").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    blocks = F.sequence(F.floor(F.col("ahead") / block), F.floor((F.col("ahead") + F.col("sum") - 1) / block))
    index = sums.select("source", F.explode(blocks).alias("block"), F.col("bucket").alias("at"), "ahead")
    turn = F.floor(F.col("repeat") / TURNS)
    placed = drawn.hint("merge").join(index, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "at", "ahead", turn.alias("turn"), F.lit(None).cast("bigint").alias("copy"))
    each = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    left_out = bucketed(copies).select(*[F.lit(None).cast(t).alias(c) for c, t in (("shard", "bigint"), ("slot", "bigint"))], "source", *[F.lit(None).cast("bigint").alias(c) for c in ("block", "repeat")], F.col("bucket").alias("at"), F.lit(None).cast("bigint").alias("ahead"), each.alias("turn"), F.col("doc_id").alias("copy"))
    placed = placed.unionAll(left_out).withColumn("of", F.col("source"))
    parts = texts.withColumn("group", each).groupBy("source", "bucket", "group").cogroup(placed.groupBy("of", "at", "turn")).applyInArrow(_fill(block), PART)
    key = ["shard", "slot", "source", "block", "repeat"]
    ordered = F.array_sort(F.collect_list(F.struct("start", "ids")))
    edges = parts.where("not whole").groupBy(*key).agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
    return parts.where("whole").select(*key, "ids").unionAll(edges)


def _slots(stats: pd.DataFrame, slots: int) -> object:
    names, totals, blocks = stats["source"].tolist(), stats["slots"].to_numpy(np.int64), stats["blocks"].to_numpy(np.int64)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts, before = shard_counts(int(shard), totals, slots)
                source = np.repeat(np.arange(len(names)), counts)
                place = permuted(np.arange(len(source)), len(source), SEED + int(shard))
                number = np.concatenate([before[s] + np.arange(counts[s]) for s in range(len(names))]) if len(source) else np.zeros(0, np.int64)
                turn, index = number // np.maximum(blocks[source], 1), number % np.maximum(blocks[source], 1)
                block = np.zeros_like(number)
                for s in range(len(names)):
                    for r in np.unique(turn[source == s]):
                        at = (source == s) & (turn == r)
                        block[at] = permuted(index[at], int(blocks[s]), SEED * 1_000_003 + s * 1009 + int(r))
                yield pd.DataFrame({"shard": int(shard), "slot": place, "source": [names[s] for s in source], "block": block, "repeat": turn})

    return draw


def mixed(documents: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, pd.DataFrame]:
    """(mix, lengths, plan): the mix has (shard, slot, source, block, repeat,
    n_tokens, ids), one row a slot."""
    spark = documents.sparkSession
    encoded, copies, lengths = encoded_sources(documents, targets)
    tokens = lengths.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("texts"))
    # One row for each listed source: the targets are a fixed table.
    stats, slots = plan(targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").join(tokens, "source", "left").fillna(0, ["tokens", "texts"]).toPandas())
    shards = -(-slots // SHARD)
    drawn = spark.range(shards).repartition(max(1, min(shards // 16 + 1, 4096))).mapInPandas(_slots(stats, slots), "shard BIGINT, slot BIGINT, source STRING, block BIGINT, repeat BIGINT")
    tokens = dict(zip(stats["source"], stats["tokens"].astype(int).tolist()))
    turns = {r.source: -(-int(r.slots) // max(int(r.blocks), 1)) for r in stats.itertuples()} if slots else {}
    out = filled(drawn, encoded, copies, lengths, tokens, turns)
    return out.select("shard", "slot", "source", "block", "repeat", F.size("ids").alias("n_tokens"), "ids"), lengths, stats


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    return mixed(documents, targets)[0]


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, available_tokens, mix_tokens,
    actual_share, most_repeats): what the mix really holds."""
    out, _, stats = mixed(documents, targets)
    used = out.groupBy("source").agg(F.sum("n_tokens").alias("mix_tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    known = documents.sparkSession.createDataFrame(
        [(r.source, float(r.target_share), int(r.max_repeats), int(r.texts), int(r.tokens)) for r in stats.itertuples()],
        "source STRING, target_share DOUBLE, max_repeats INT, texts BIGINT, available_tokens BIGINT",
    )
    total = Window.partitionBy(F.lit(1))  # over the listed sources, a fixed table
    rows = known.join(used, "source", "left").fillna(0, ["mix_tokens", "most_repeats"])
    return rows.withColumn("actual_share", F.round(F.col("mix_tokens") / F.greatest(F.sum("mix_tokens").over(total), F.lit(1)), 6))
