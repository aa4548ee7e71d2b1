import random
import re

import numpy as np
from pyspark.sql import functions as F

from ontoloom.llm import neardup

def TEXT():
    return neardup.text_of("claim", "source_quote")



def brute(rows, threshold):
    sets = {k: frozenset(re.findall("[a-z0-9]+", f"{c or ''} {q or ''}".lower())) for k, c, q in rows if k is not None}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0) for r in rows], "claim_key BIGINT, claim STRING, source_quote STRING, rep BIGINT, tokens INT")


def sample(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["the", "of", "to"] * 10
    base = [[rng.choice(words) for _ in range(rng.randint(3, 50))] for _ in range(60)]
    rows = []
    for key in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((key, " ".join(text), rng.choice([None, "", "end"])))
    return rows + [(1000, None, None), (1001, "", ""), (None, "lost row", "x"), rows[3], rows[3], (1002, "w1 " * 20000, None), (1003, "w1", None)]


def test_equals_brute_force(spark):
    rows = sample(5)
    got = [tuple(r) for r in neardup.similar_pairs(table(spark, rows), "claim_key", TEXT(), 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7)


def test_hot_lists_give_the_same_pairs(spark):
    rows = sample(6)
    _, sets = neardup.representatives(neardup.token_sets(table(spark, rows), "claim_key", TEXT()))
    want = {tuple(r)[:2] for r in neardup.similar_classes(sets, 0.7).collect()}
    for hot in (40, 100):
        assert {tuple(r)[:2] for r in neardup.similar_classes(sets, 0.7, hot=hot).collect()} == want


def test_groups_one_row_a_key(spark):
    rows = sample(7, 120)
    got = {r["claim_key"]: (r["group_id"], r["links"]) for r in neardup.similar_groups(table(spark, rows), "claim_key", TEXT(), 0.7).collect()}
    assert set(got) == {k for k, _, _ in rows if k is not None}
    for a, b in brute(rows, 0.7):
        assert got[a][0] == got[b][0] <= min(a, b)


def test_empty_table(spark):
    assert neardup.similar_pairs(table(spark, []), "claim_key", TEXT(), 0.7).count() == 0


def test_copies_are_one_class(spark):
    rows = [(k, "one two three four", None) for k in range(40)] + [(100, "one two three four five", None)]
    got = {tuple(r) for r in neardup.similar_pairs(table(spark, rows), "claim_key", TEXT(), 0.7).collect()}
    assert got == brute(rows, 0.7)


def frequent(seed, n=300):
    """Variants of one text at about 0.7, all of whose tokens are in more than 32 records."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for key in range(n):
        text = rng.sample(words[:30], rng.randint(23, 28)) + rng.sample(words[30:], rng.randint(2, 4))
        rows.append((key, " ".join(text), None))
    return rows


def test_pairs_of_frequent_tokens_only(spark):
    for seed in (8, 9):
        rows = frequent(seed)
        sets = [set(c.split()) for _, c, _ in rows]
        assert min(sum(w in s for s in sets) for w in set().union(*sets)) > 32
        got = [tuple(r) for r in neardup.similar_pairs(table(spark, rows), "claim_key", TEXT(), 0.7).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7)


def test_blocks_of_long_lists_give_the_same_pairs(spark):
    rows = frequent(10, 200)
    _, sets = neardup.representatives(neardup.token_sets(table(spark, rows), "claim_key", TEXT()))
    got = [tuple(r)[:2] for r in neardup.similar_classes(sets, 0.7, hot=5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.7)


def test_boxes_hold_just_the_pairs_within_reach():
    rng = np.random.default_rng(3)
    value, n = rng.integers(0, 4, 900), rng.integers(20, 40, 900)
    u = n + rng.integers(-9, 12, 900)
    order = np.lexsort((-u, n, value))
    value, n, u = value[order], n[order], u[order]
    got, compared = [], 0
    for a, b, rows, cols in neardup._boxes(value, n, u):
        for i, j, r, c in zip(*map(np.atleast_1d, (a, b, rows, cols))):
            compared += r * c
            got += [(x, y) for x in range(i, i + r) for y in range(j, j + c) if x < y]
    want = {(i, j) for i in range(900) for j in range(i + 1, 900) if value[i] == value[j] and n[i] <= u[j] and n[j] <= u[i]}
    assert len(got) == len(set(got)) and set(got) == want and compared < 1.5 * len(want)


def test_long_lists_are_not_joined_row_by_row(spark, monkeypatch):
    """Blocks of a long list are merged by size and reach, as short lists are."""
    monkeypatch.setattr(neardup, "TILE", 64, raising=False)
    rows = frequent(11, 150)
    _, sets = neardup.representatives(neardup.token_sets(table(spark, rows), "claim_key", TEXT()))
    joins = []
    blocks = neardup._blocks
    monkeypatch.setattr(neardup, "_blocks", lambda *args: joins.append(blocks(*args)) or joins[-1])
    assert {tuple(r)[:2] for r in neardup.similar_classes(sets, 0.7, hot=3).collect()} == brute(rows, 0.7)
    assert joins and "bit_count" not in joins[0]._jdf.queryExecution().optimizedPlan().toString()
