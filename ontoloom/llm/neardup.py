"""Near-duplicate records: a signature-coordinate inverted join.

A record's set holds the distinct runs of ASCII letters and digits of its
lower-cased text. Records with equal sets are one class; one representative of
each class is compared.

1. *Order.* Tokens are ordered by frequency: first those of at most ``skip``
   records, by hash, then the ``skip_tokens`` most frequent of the others, rarest
   first. The list of the latter is broadcast at 12 bytes a token, so its bound is
   the parameter. Should more tokens be that frequent, the rest of them count as
   rare; any order gives the same pairs.
2. *Coordinates.* A class of n tokens is posted under the first n - ceil(tn) + 1
   of them in that order, t being the threshold. Two classes at or above it share
   at least tn tokens of either, so they share one that both are posted under,
   however frequent their tokens are. A posting carries n and the size u of the
   largest class that can still match if this token is the first shared one.
3. *Collisions.* Lists are merged in order of coordinate value, and within a list
   in order of size and reach: two sizes meet in a box that holds the postings within
   each other's reach and no others. A posting carries a signature of ``BITS`` coordinates, each the parity of the tokens that hash to
   it. Two classes differ in at least as many tokens as coordinates, so a pair at
   the threshold collides in all but (1-t)/(1+t)(n+m) of them at most: the match
   threshold loses nothing. Where that bound says little (n + m above ``LONG``)
   ``BITS`` one-bit min-hashes are counted instead, with a bound 5.2 standard
   deviations below what is expected at the threshold (one pair in ten million).
4. *Exact check* on the token sets of the pairs that are left.

A list longer than ``TOGETHER`` times ``hot`` is not merged in one task: it is cut
into blocks of half that, and any two blocks are merged as a list of their own. No
list and no pair is dropped. Where all tokens are frequent the comparisons grow with the
square of the records.

Defined cases: null texts count as empty; records without a token, or without a
key, are in no pair; rows repeated with the same key count once; an empty table
gives no pairs."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import written

BITS, LONG, TOGETHER, PER_TASK, TILE = 128, 290, 16, 2_000_000, 1 << 17
#: Two words of parities, two of one-bit min-hashes (zero in classes too short to need them).
SIGNATURE = ("s1", "s2", "s3", "s4")
SEED = 20261
POSTING = "value BIGINT, rep BIGINT, s1 BIGINT, s2 BIGINT, s3 BIGINT, s4 BIGINT, n INT, u INT"
MERGED = "value BIGINT, a BIGINT, b BIGINT, s1 BIGINT, s2 BIGINT, s3 BIGINT, s4 BIGINT, n INT, u INT"


def token_hashes(text: Column) -> Column:
    """Sorted distinct 64-bit hashes of the runs of ASCII letters and digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(runs, lambda t: F.xxhash64(t))))


def text_of(*columns: str) -> Column:
    """The columns joined by a blank, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def token_sets(records: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, h1, h2, tokens), written once: h1 and h2 name the set's class."""
    return written(
        records.where(F.col(key).isNotNull())
        .select(F.col(key).cast("bigint").alias("key"), token_hashes(text).alias("tokens"))
        .withColumns({"h1": F.xxhash64("tokens"), "h2": F.hash("tokens", F.lit(7))})
        .where(F.size("tokens") > 0)
    )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _signatures(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, threshold: float) -> list[np.ndarray]:
    """The words of SIGNATURE of the classes whose tokens lie one after another in ``flat``."""
    base = _mix(flat.view(np.uint64))
    bit, low = base & np.uint64(63), (base >> np.uint64(6)) & np.uint64(1)
    one = np.uint64(1) << bit
    words = [np.bitwise_xor.reduceat(np.where(low == w, one, np.uint64(0)), starts) for w in (np.uint64(0), np.uint64(1))]
    hashed = [np.zeros(len(starts), dtype=np.uint64) for _ in range(2)]
    far = np.flatnonzero(lens * (1 + 1 / threshold) > LONG)
    if len(far):
        rng = np.random.default_rng(SEED)
        mult = rng.integers(1, 2**63, BITS, dtype=np.uint64) | np.uint64(1)
        add = rng.integers(0, 2**63, BITS, dtype=np.uint64)
        for k in far:
            own = base[starts[k] : starts[k] + lens[k]]
            for j in range(BITS):
                hashed[j // 64][k] |= (_mix((own * mult[j] + add[j]).min()) & np.uint64(1)) << np.uint64(j % 64)
    return [w.view(np.int64) for w in (*words, *hashed)]


def _post(skipped: object, threshold: float) -> object:
    """Postings of each class; ``skipped`` is the broadcast of the frequent tokens
    and their places in the order."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, places = skipped.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo in range(0, len(batch), 2000):
                    part = batch.iloc[lo : lo + 2000]
                    size, rep = len(part), part["key"].to_numpy()
                    lens = part["tokens"].map(len).to_numpy()
                    flat = np.concatenate(part["tokens"].to_numpy()).astype(np.int64)
                    row = np.repeat(np.arange(size), lens)
                    starts = np.cumsum(lens) - lens
                    place = np.zeros(len(flat), dtype=np.int32)
                    if len(frequent):
                        near = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
                        place = np.where(frequent[near] == flat, places[near], 0)
                    words = _signatures(flat, starts, lens, threshold)
                    first = lens - np.ceil(threshold * lens - 1e-9).astype(np.int64) + 1
                    order = np.lexsort((flat, place, row))
                    passed = np.arange(len(flat)) - np.repeat(starts, lens)
                    kept = passed < np.repeat(first, lens)
                    posted, passed = order[kept], passed[kept]
                    at = row[posted]
                    n = lens[at]
                    u = np.floor((n - passed) * (1 + threshold) / threshold + 1e-6).astype(np.int64) - n
                    yield pd.DataFrame({"value": flat[posted], "rep": rep[at], **{c: w[at] for c, w in zip(SIGNATURE, words)}, "n": n.astype(np.int32), "u": u.astype(np.int32)})

    return post


def least_match(threshold: float, sigmas: float = 5.2, bits: int = BITS) -> int:
    """The match threshold of the one-bit min-hashes."""
    p = (1 + threshold) / 2
    return math.floor(bits * p - sigmas * math.sqrt(bits * p * (1 - p)))


def _set_places(flags: np.ndarray) -> np.ndarray:
    """np.flatnonzero of flags that are mostly unset."""
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64))
    row, col = np.nonzero(flags[:whole].reshape(-1, 8)[some])
    return np.r_[some[row] * 8 + col, whole + np.flatnonzero(flags[whole:])]


def _boxes(value: np.ndarray, n: np.ndarray, u: np.ndarray) -> Iterator[tuple]:
    """The pairs of postings within each other's reach, as boxes (first row, first
    column, rows, columns) of postings sorted by value, n and falling u. Those of a
    list and size that reach another size come first among their own, so a box is all
    that two sizes of a list have to compare. Small boxes come many at once, as arrays."""
    fresh = np.r_[True, (value[1:] != value[:-1]) | (n[1:] != n[:-1])]
    at, group, width = np.flatnonzero(fresh), np.cumsum(fresh) - 1, int(max(n.max(), u.max())) + 1
    size, of = n[at], np.cumsum(np.r_[0, value[at][1:] != value[at][:-1]])
    reach = np.searchsorted(of * width + size, of * width + u[at], "right")
    count = np.maximum(reach - np.arange(len(at)), 0)
    g = np.repeat(np.arange(len(at)), count)
    h = g + np.arange(len(g)) - np.repeat(np.cumsum(count) - count, count)
    key = group * width - u
    rows = np.searchsorted(key, g * width - size[h], "right") - at[g]
    cols = np.searchsorted(key, h * width - size[g], "right") - at[h]
    area = np.where((g == h) & (rows < 2), 0, rows * cols)
    a, b, few = at[g], at[h], np.flatnonzero((area > 0) & (area <= 4096))
    for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(area[few]) // TILE)) + 1):
        if len(part):
            yield a[part], b[part], rows[part], cols[part]
    for k in np.flatnonzero(area > 4096):
        yield int(a[k]), int(b[k]), int(rows[k]), int(cols[k])


def _merge(threshold: float, hot: int) -> object:
    """Merges posting lists that arrive sorted by value and rep. Gives pairs
    (value null), and the postings of lists longer than ``hot`` (b null)."""
    share, most_hashed = (1 - threshold) / (1 + threshold), BITS - least_match(threshold)

    def alike(words: list, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j), near by their folded words, stay."""
        both = n[i] + n[j]
        differ = np.bitwise_count(words[0][i] ^ words[0][j]).astype(np.int16) + np.bitwise_count(words[1][i] ^ words[1][j])
        ok = differ <= share * both + 1e-6
        if (both > LONG).any():
            differ = np.bitwise_count(words[2][i] ^ words[2][j]).astype(np.int16) + np.bitwise_count(words[3][i] ^ words[3][j])
            ok &= (both <= LONG) | (differ <= most_hashed)
        return ok

    def pairs(lists: dict[str, np.ndarray]) -> pa.RecordBatch:
        order = np.lexsort((-lists["u"], lists["n"], lists["value"]))
        value, rep = lists["value"][order], lists["rep"][order]
        n, u = (lists[c][order].astype(np.int64) for c in ("n", "u"))
        words = [lists[c][order].view(np.uint64) for c in SIGNATURE]
        left, right, folded = [rep[:0]], [rep[:0]], words[0] ^ words[1]

        def keep(i: np.ndarray, j: np.ndarray) -> None:
            ok = alike(words, n, i, j)
            left.append(rep[i[ok]])
            right.append(rep[j[ok]])

        for a, b, rows, cols in _boxes(value, n, u):
            if isinstance(a, np.ndarray):
                area = rows * cols
                local = np.arange(area.sum()) - np.repeat(np.cumsum(area) - area, area)
                down, across = np.divmod(local, np.repeat(cols, area))
                i, j = np.repeat(a, area) + down, np.repeat(b, area) + across
                near = np.flatnonzero((i < j) & (np.bitwise_count(folded[i] ^ folded[j]) <= share * (n[i] + n[j]) + 1e-6))
                keep(i[near], j[near])
                continue
            most, step = int(share * (n[a] + n[b]) + 1e-6), max(1, TILE // cols)
            for lo in range(a, a + rows, step):
                near = np.bitwise_count(folded[lo : min(lo + step, a + rows), None] ^ folded[b : b + cols]) <= most
                i, j = np.divmod(_set_places(near.ravel()), cols)
                i, j = i + lo, j + b
                if a == b:
                    i, j = i[i < j], j[i < j]
                keep(i, j)
        found = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return table(None, found[0], found[1], {})

    def table(value: np.ndarray | None, a: np.ndarray, b: np.ndarray | None, rest: dict) -> pa.RecordBatch:
        none, zero = pa.nulls(len(a), pa.int64()), np.zeros(len(a), dtype=np.int64)
        columns = {"value": none if value is None else pa.array(value), "a": pa.array(a), "b": none if b is None else pa.array(b), **{c: pa.array(rest.get(c, zero)) for c in SIGNATURE}}
        return pa.record_batch(columns | {c: pa.array(rest.get(c, zero).astype(np.int32)) for c in ("n", "u")})

    def long_list(part: dict[str, np.ndarray]) -> pa.RecordBatch:
        return table(part["value"], part["rep"], None, part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("value", "rep", *SIGNATURE, "n", "u")
        rest, more, hot_value = {c: np.zeros(0, dtype=np.int64) for c in names}, [], None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                more.append({c: batch.column(c).to_numpy() for c in names})
                held = len(rest["value"]) + sum(len(m["value"]) for m in more)
                if held <= hot and more[-1]["value"][-1] == (rest if len(rest["value"]) else more[0])["value"][0]:
                    continue  # one list goes on
            if more:
                rest, more = {c: np.concatenate([rest[c], *[m[c] for m in more]]) for c in names}, []
            if not len(rest["value"]):
                continue
            fresh = np.r_[True, (rest["value"][1:] != rest["value"][:-1]) | (rest["rep"][1:] != rest["rep"][:-1])]
            rest = {c: v[fresh] for c, v in rest.items()}
            last = rest["value"][-1]
            cut = int(np.searchsorted(rest["value"], last))
            done, rest = {c: v[:cut] for c, v in rest.items()}, {c: v[cut:] for c, v in rest.items()}
            if cut:
                starts = np.flatnonzero(np.r_[True, done["value"][1:] != done["value"][:-1]])
                sizes = np.diff(np.r_[starts, cut])
                large = np.repeat((sizes > hot) | (done["value"][starts] == hot_value if hot_value is not None else False), sizes)
                if large.any():
                    yield long_list({c: v[large] for c, v in done.items()})
                    done = {c: v[~large] for c, v in done.items()}
                if len(done["value"]):
                    yield pairs(done)
            if last == hot_value or len(rest["value"]) > hot:
                hot_value = last
                yield long_list(rest)
                rest = {c: v[:0] for c, v in rest.items()}
        if len(rest["value"]):
            yield long_list(rest) if rest["value"][0] == hot_value else pairs(rest)

    return merge


def _posted(postings: DataFrame, tasks: int, threshold: float, hot: float) -> DataFrame:
    """Posting lists merged: each list in one task, in order of its value."""
    return postings.repartition(tasks, "value").sortWithinPartitions("value", "rep").mapInArrow(_merge(threshold, hot), MERGED)


def _blocks(long_lists: DataFrame, threshold: float, block: int, tasks: int) -> DataFrame:
    """Pairs within long lists: each list is cut into blocks of about ``block`` rows by
    a hash of the rep; any two blocks of a list make a list of their own, which is
    merged like the others."""
    lists = long_lists.select("value", F.col("a").alias("rep"), *SIGNATURE, "n", "u").distinct()
    sizes = lists.groupBy("value").agg(F.greatest(F.lit(2), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    own = lists.join(sizes, "value").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    cells = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other")
    cells = cells.withColumn("value", F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other")))
    return _posted(cells.select("value", "rep", *SIGNATURE, "n", "u"), tasks, threshold, math.inf).select("a", "b")


def representatives(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members(rep, key) of the classes with copies, sets of the
    representatives): classes of one record have no row among the members."""
    keys = sets.select("key", "h1", "h2").distinct()
    reps = keys.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    members = written(keys.join(reps, ["h1", "h2"]).select("rep", "key"))
    copies = members.where(F.col("key") != F.col("rep")).select("key")
    return members, sets.join(copies, "key", "left_anti")


def similar_classes(sets: DataFrame, threshold: float, skip: int = 32, skip_tokens: int = 1_000_000, hot: int = 50_000) -> DataFrame:
    """(a, b, similarity) of ``sets(key, tokens)``, for a < b at or above the
    threshold, written once."""
    spark = sets.sparkSession
    frequent = (
        sets.select(F.explode("tokens").alias("token"))
        .groupBy("token").agg(F.count("*").alias("df"))
        .where(F.col("df") > skip)
        .orderBy(F.desc("df"), "token").limit(skip_tokens)
        .select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    )
    by_hash = np.argsort(frequent)
    skipped = spark.sparkContext.broadcast((frequent[by_hash], (len(frequent) - by_hash).astype(np.int32)))
    posts = sets.select("key", "tokens").mapInPandas(_post(skipped, threshold), POSTING)
    tokens = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens * (1 - threshold) / PER_TASK))
    merged = written(_posted(posts, tasks, threshold, TOGETHER * hot))
    met = merged.where(F.col("b").isNotNull()).select("a", "b")
    long_lists = merged.where(F.col("b").isNull())
    if not long_lists.isEmpty():
        met = met.unionAll(_blocks(long_lists, threshold, TOGETHER * hot // 2, tasks))
    met = written(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = met.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = sets.select("key", "tokens").join(ids, "key", "left_semi").dropDuplicates(["key"])
    one, two = sets.toDF("a", "ta"), sets.toDF("b", "tb")
    return written(
        met.join(one, "a").join(two, "b")
        .withColumn("shared", F.size(F.array_intersect("ta", "tb")))
        .withColumn("similarity", F.col("shared") / (F.size("ta") + F.size("tb") - F.col("shared")))
        .where(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )


def similar_pairs(records: DataFrame, key: str, text: Column, threshold: float) -> DataFrame:
    """(key_a, key_b): every pair of different keys at or above the threshold."""
    members, sets = representatives(token_sets(records, key, text))
    links = similar_classes(sets, threshold)
    one, two = members.toDF("a", "x"), members.toDF("b", "y")
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    within = members.toDF("rep", "x").join(members.toDF("rep", "y"), "rep").where(F.col("x") < F.col("y")).select("x", "y")
    return between.unionAll(within).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def similar_groups(records: DataFrame, key: str, text: Column, threshold: float) -> DataFrame:
    """(key, group_id, links): one row per key with the smallest key of its
    connected group, and its number of links to other texts."""
    sets = token_sets(records, key, text)
    members, firsts = representatives(sets)
    links = similar_classes(firsts, threshold)
    groups = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    linked = groups.join(degree, "node", "left").select(F.col("node").alias("rep"), F.col("component").alias("group_id"), "links")
    keys = records.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key")).distinct()
    keys = keys.join(members, "key", "left").withColumn("rep", F.coalesce("rep", "key"))
    return keys.join(linked, "rep", "left").select(
        F.col("key").alias(key), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )
