from __future__ import annotations

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from vectrail.llm import mixing as M


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 4)), max_size=5, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_knapsack_is_exact(items, target):
    sums = {0}
    for size, count in items:
        sums = {s + size * k for s in sums for k in range(count + 1)}
    best, taken = M.knapsack(items, target)
    assert best == max(s for s in sums if s <= target) == sum(n * k for n, k in taken.items())
    assert all(taken.get(n, 0) <= c for n, c in items)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 30), min_size=1, max_size=8), st.integers(0, 3000))
def test_fit_stays_within_counts_and_budget(counts, target):
    lengths = sorted(counts)
    take = M.fit(lengths, [counts[n] for n in lengths], target, M.MixRules(window=64))
    got = sum(n * t for n, t in zip(lengths, take))
    assert all(0 <= t <= counts[n] for n, t in zip(lengths, take)) and got <= target
    if 1 in counts and sum(n * c for n, c in counts.items()) >= target:
        assert got >= target - 64


def test_weights_are_met(documents):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "abc"[i % 3]) for i in range(600)]
    out = M.mix_sources(documents(rows), rules=M.MixRules(weights={"a": 0.5, "b": 0.3, "c": 0.2}, budget=5000))
    tokens = Counter()
    for r in out.collect():
        tokens[r.source] += r.n_tokens
        assert r.n_tokens == len(r.text.split())
    assert tokens == {"a": 2500, "b": 1500, "c": 1000}
    again = {r.doc_id for r in M.mix_sources(documents(rows).repartition(5), rules=M.MixRules(weights={"a": 0.5, "b": 0.3, "c": 0.2}, budget=5000)).collect()}
    assert again == {r.doc_id for r in out.collect()}  # the seed decides, not the layout


def test_edges(documents):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "x y", "a"), (4, "x y", "a"), (4, "x y", "a"), (None, "x y z", "a"), (5, "w " * 50_000, "b")]
    df = documents(rows).withColumnRenamed("lang", "n_tokens")
    out = M.mix_sources(df, rules=M.MixRules(weights={"a": 1.0}, budget=4)).collect()
    assert sum(r.n_tokens for r in out) == 4 and {r.source for r in out} == {"a"}
    every = M.mix_sources(df, rules=M.MixRules(weights={"a": 9.0, "b": 50000.0, "": 2.0}))
    assert sorted(r.n_tokens for r in every.collect()) == [2, 2, 2, 2, 3, 50_000]
    assert M.mix_sources(df.filter("false")).count() == 0


def test_a_stray_source_does_not_limit_the_others(documents):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(5, 60)), "abbb"[i % 4]) for i in range(800)] + [(900, "w " * 20, None)]
    had = sum(len(t.split()) for _, t, _ in rows)
    tokens = Counter()
    for r in M.mix_sources(documents(rows, source=None)).collect():
        tokens[r.source] += r.n_tokens
    assert tokens[None] == 20 and 0.89 * had < sum(tokens.values()) <= 0.9 * had
    # "s" can't give its half of 1,000: it gives all it has, the rest comes 3 to 1.
    some = [*rows[:800], (901, "w " * 100, "s")]
    rules = M.MixRules(weights={"s": 4, "a": 3, "b": 1}, budget=1000)
    tokens = Counter()
    for r in M.mix_sources(documents(some), rules=rules).collect():
        tokens[r.source] += r.n_tokens
    assert tokens == {"s": 100, "a": 675, "b": 225}
    assert M.mix_sources(documents(some), rules=M.MixRules(budget=10**9)).count() == len(some)
    even = [(i, "w " * 10, "abcd"[i % 4]) for i in range(400)]
    assert Counter(r.source for r in M.mix_sources(documents(even), rules=M.MixRules(budget=2000)).collect()) == dict.fromkeys("abcd", 50)


def test_the_whole_selection_by_brute_force(spark, documents):
    """Targets by small steps, sums by the set of all that can be reached, the
    documents of a length by their hashes."""
    from collections import defaultdict

    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 5, 8, 13, 40])), "aaabc"[i % 5]) for i in range(400)] + [(500, "w w w", "d"), (501, None, "a"), (7, "w w", None)]
    df = documents([*rows, rows[3], rows[3]])
    rules = M.MixRules(weights={"a": 1.0, "b": 3.0}, other=1.0, share=0.6)
    got = M.mix_sources(df, rules=rules).collect()
    held = defaultdict(list)
    for r in df.withColumn("h", F.xxhash64(F.lit(rules.seed), "doc_id", "text")).collect():
        if r.text:
            held[r.source or "", len(r.text.split())].append((r.h, r.doc_id))
    total = Counter()
    for (s, n), docs in held.items():
        total[s] += n * len(docs)
    weight = {s: rules.weights.get(s, rules.other) for s in total}
    budget, level = 0.6 * sum(total.values()), 0.0
    while sum(min(total[s], level * weight[s]) for s in total) < budget - 1e-6:
        level += 0.001
    took = defaultdict(list)
    for r in got:
        took[r.source or "", r.n_tokens].append(r.doc_id)
    for s in total:
        target = int(min(total[s], level * weight[s]) + 1e-2)
        reach = {0}
        for (t, n), docs in held.items():
            if t == s:
                reach = {x + n * k for x in reach for k in range(len(docs) + 1) if x + n * k <= target}
        assert abs(sum(n * len(d) for (t, n), d in took.items() if t == s) - max(reach)) <= 1
    for key, docs in took.items():
        assert sorted(docs) == sorted(d for _, d in sorted(held[key])[: len(docs)])


def test_input_columns_stay(documents):
    df = documents([(i, "w " * (i + 1), "ab"[i % 2]) for i in range(30)]).withColumnRenamed("lang", "n_tokens")
    kept = M.keep_mixture(df)
    assert kept.columns == df.columns and {r.n_tokens for r in kept.collect()} == {"en"}
