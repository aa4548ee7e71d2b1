import numpy as np
import pytest

from ontoloom.llm import mix

TARGETS = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("void", 0.0, 3)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"text {i} of source a " * 40, "a") for i in range(200)] + [(1000 + i, f"b text number {i} " * 30, "b") for i in range(60)] + [(2000 + i, f"c says {i} " * 30, "c") for i in range(20)]
    rows += [(3000, "unlisted", "zz"), (3001, None, "a"), (3002, "", "b"), (3003, "no source", None), (3004, rows[0][1], "a"), (3005, rows[0][1], "c")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id BIGINT, text STRING, source STRING, part INT, block INT")
    return docs, spark.createDataFrame([(*t, 9) for t in TARGETS], "source STRING, target_share DOUBLE, max_repeats INT, tokens INT")


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_permutations_are_bijections(size):
    for key in (1, 99):
        assert sorted(mix.permuted(np.arange(size), size, key)) == list(range(size))


def test_shard_counts_add_up():
    totals = np.array([1000, 333, 40, 0])
    slots = int(totals.sum())
    shards = [mix.shard_counts(k, totals, slots) for k in range(-(-slots // mix.SHARD))]
    assert (sum(c for c, _ in shards) == totals).all() and all(c.sum() <= mix.SHARD for c, _ in shards)
    assert all((before == sum((c for c, _ in shards[:k]), np.zeros(4, dtype=np.int64))).all() for k, (_, before) in enumerate(shards))


def test_shares_and_caps(tables):
    docs, targets = tables
    rows = {r.source: r for r in mix.shares(docs, targets).collect()}
    assert abs(rows["a"].actual_share - 0.5) < 0.03 and abs(rows["b"].actual_share - 0.3) < 0.03 and abs(rows["c"].actual_share - 0.2) < 0.03
    assert rows["void"].mix_tokens == 0 and all(rows[s].most_repeats <= cap for s, _, cap in TARGETS)
    assert rows["a"].texts == 200 and rows["c"].texts == 20


def every_block(made, repeats=1):
    """One slot for each block of each source and repetition."""
    encoded, copies, lengths = made
    spark = encoded.sparkSession
    tokens = {r[0]: r[1] for r in lengths.groupBy("source").sum("n").collect()}
    slots = [(0, i, s, i, r) for s, n in tokens.items() for i in range(-(-n // mix.BLOCK)) for r in range(repeats)]
    drawn = spark.createDataFrame(slots, "shard BIGINT, slot BIGINT, source STRING, block BIGINT, repeat BIGINT")
    return mix.filled(drawn, encoded, copies, lengths, tokens, dict.fromkeys(tokens, repeats))


def test_blocks_hold_every_token_once(tables):
    docs, targets = tables
    out, lengths, _ = mix.mixed(docs, targets)
    made = mix.encoded_sources(docs, targets)
    blocks = every_block(made)
    assert {r[0] for r in lengths.select("source").distinct().collect()} == {"a", "b", "c"}
    assert {r.doc_id for r in made[1].collect()} == {3004, 3005} and made[0].count() == lengths.count() + 2
    assert blocks.selectExpr("sum(size(ids))").first()[0] == lengths.selectExpr("sum(n)").first()[0]
    used = out.groupBy("source", "block").count().groupBy("source").agg({"count": "max"}).collect()
    assert all(r[1] <= {s: c for s, _, c in TARGETS}[r[0]] for r in used)
    assert out.select("shard", "slot").distinct().count() == out.count()


def test_layout_and_buckets_do_not_matter(tables, monkeypatch):
    docs, targets = tables
    want = {(r.shard, r.slot): (r.source, r.block, tuple(r.ids)) for r in mix.mix(docs, targets).collect()}
    other = {(r.shard, r.slot): (r.source, r.block, tuple(r.ids)) for r in mix.mix(docs.repartition(7, "text"), targets).collect()}
    assert want == other
    made = mix.encoded_sources(docs, targets)
    for bucket in (300, 1 << 20):
        monkeypatch.setattr(mix, "BUCKET", bucket)
        repeats = 20
        rows = every_block(made, repeats).collect()
        assert len(rows) == len({(r.source, r.block, r.repeat) for r in rows}) and all(len({tuple(x.ids) for x in rows if (x.source, x.block) == (r.source, r.block)}) == 1 for r in rows[:9])
        blocks = [r for r in rows if r.repeat == 19]
        assert len(blocks) == len({(r.source, r.block) for r in blocks})
        sizes = {}
        for r in blocks:
            sizes.setdefault(r.source, {})[r.block] = len(r.ids)
        assert all(sorted(v) == list(range(len(v))) and all(n == mix.BLOCK for b, n in v.items() if b + 1 < len(v)) for v in sizes.values())


def test_empty(tables):
    docs, targets = tables
    assert mix.mix(docs.limit(0), targets).count() == 0
