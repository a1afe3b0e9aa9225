"""The mixture: exact shares, repeats within the cap, every block complete, permutations that are ones."""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tahlil.llm import mixture, tokens


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3_000), st.integers(0, 2**31))
def test_permutation(size, key):
    x = np.arange(size)
    assert sorted(mixture.permuted(x, np.full(size, size), np.full(size, key))) == list(range(size))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50_000), st.integers(1, 4), st.floats(0.01, 1)), min_size=1, max_size=6), st.integers(1, 600))
def test_targets(some, block):
    s = pd.DataFrame([{"source": str(i), "tokens": n, "max_repeats": r, "weight": w} for i, (n, r, w) in enumerate(some)])
    t = mixture.targets(s, block)
    assert (t.goal <= t.tokens * t.max_repeats).all() and (t.goal >= 0).all()
    assert (abs(t.goal - t.weight / t.weight.sum() * t.goal.sum()) <= 1 + len(t)).all()
    assert (t.goal + len(t) >= (t.tokens * t.max_repeats)).any() or (t.goal == t.tokens * t.max_repeats).any() or t.goal.sum() + len(t) + 1 >= (t.tokens * t.max_repeats / (t.weight / t.weight.sum())).min() - 1
    # the slots hold the goal
    full, rest = t.goal // t.tokens, t.goal % t.tokens
    assert (full * t.tokens + rest == t.goal).all() and (t.slots <= t.max_repeats * t.blocks).all()
    assert ((t["last"] >= 1) & (t["last"] <= block)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5_000), min_size=1, max_size=5), st.integers(1, 700))
def test_shard_counts(slots, size):
    shards = -(-sum(slots) // size)
    got = [mixture.shard_counts(tuple(slots), k, size) for k in range(shards)]
    counts = [c for c, _ in got]
    assert not got or (sum(counts).tolist() == slots and all((c >= 0).all() for c in counts))
    assert all(c.sum() == size for c in counts[:-1])
    for k, (_, before) in enumerate(got):
        assert before.tolist() == (sum(counts[:k]).tolist() if k else [0] * len(slots))


def test_very_many_slots():
    slots = (30_000_000_000, 12_000_000_000, 7)
    got = [mixture.shard_counts(slots, k) for k in (0, 5_000_000, -(-sum(slots) // mixture.SHARD_SLOTS) - 1)]
    assert all(abs(c[0] / c.sum() - 30 / 42) < 0.05 for c, _ in got)
    assert (got[-1][0] + got[-1][1]).tolist() == list(slots)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), max_size=6), max_size=5), st.integers(1, 12))
def test_packer(batches, block):
    pack, out, given_ids, key = mixture.Packer(block, "<u2"), [], {}, 0
    for some in batches:
        rows = []
        for source, n in some:
            given_ids[key] = (source, [key * 40 + i for i in range(n)])
            rows.append((key, source, given_ids[key][1]))
            key += 1
        b = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "source", "ids"])
        out += pack.batch(b)
    rest = pack.rest()
    assert all(n == block for _, _, n, _, _ in out) and all(0 < n < block for _, _, n, _, _ in rest)
    assert [sorted(k for s, k, *_ in out if s == x) for x in "ab"] == [list(range(sum(s == x for s, *_ in out))) for x in "ab"]
    seen = Counter()
    for source, _, n, docs, ids in out + rest:
        assert np.frombuffer(ids, "<u2").tolist() == [t for k, i, m in docs for t in given_ids[k][1][i : i + m]] and n == sum(m for *_, m in docs)
        assert all(given_ids[k][0] == source for k, *_ in docs)
        seen.update((k, i + j) for k, i, m in docs for j in range(m))
    assert seen == Counter((k, i) for k, (_, x) in given_ids.items() for i in range(len(x)))


@pytest.mark.parametrize(("block", "parts"), [(8, 1), (8, 9), (64, 7), (512, 3)])
def test_shares_are_exact_for_small_sources(spark, block, parts):
    docs = [(i, " ".join(f"kelime{i}x{j}" for j in range(1 + i % 9)), "big" if i % 31 else "small") for i in range(1_550)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(parts)
    target = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3)], "source string, weight double, max_repeats int")
    made = mixture.mixture(df, target, block=block, shard_slots=20)
    by = {r.source: r for r in mixture.shares(made, target).collect()}
    assert abs(by["small"].share - 0.3) < 0.001 and by["small"].most_copies <= 3
    sizes = {r.doc_id: len(r.ids) for r in tokens.encode(df.select("doc_id", "text")).collect()}
    whole = sum(n for i, n in sizes.items() if i % 31 == 0)
    assert by["small"].tokens == 3 * whole
    copies = Counter((d.doc_id, d.begin + j) for r in made.filter("source = 'small'").collect() for d in r.docs for j in range(d.n))
    assert len(copies) == whole and set(copies.values()) == {3}


def pieces_of(mix):
    return {d.doc_id for r in mix for d in r.docs}


def test_mix(spark):
    docs = [(i, " ".join(f"kelime{i}x{j}" for j in range(i % 5)), "a" if i % 3 else "b") for i in range(150)] + [(900, None, "a"), (901, "", "b"), (902, "yok", None), (903, "öbür", "c"), (None, "boş anahtar", "a")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, source string, bucket int")
    target = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("z", 0.0, 1), ("n", None, 1), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    made = mixture.mixture(df, target, block=8, shard_slots=5)
    mix = made.collect()
    ids = {r.doc_id: r.ids for r in tokens.encode(df.select("doc_id", "text")).collect()}
    caps = {"a": 1, "b": 2}
    pieces = Counter()
    for r in mix:
        assert r.ids == [t for d in r.docs for t in ids[d.doc_id][d.begin : d.begin + d.n]] and len(r.ids) == r.n_tokens <= 8
        pieces.update((r.source, d.doc_id, d.begin) for d in r.docs)
        assert r.copy < caps[r.source]
    assert all(n <= caps[s] for (s, _, _), n in pieces.items())
    assert len({(r.shard, r.slot) for r in mix}) == len(mix)
    assert not {d.doc_id for r in mix for d in r.docs} & {900, 901, 902, 903}
    by = {r.source: r for r in mixture.shares(made, target).collect()}
    assert None in pieces_of(mix)
    assert abs(by["a"].tokens - by["b"].tokens) <= 1 and by["z"].tokens == 0 and sum(r.share for r in by.values()) == 1
    assert mixture.mixture(df.limit(0), target).count() == 0 and mixture.mixture(df, target.limit(0)).count() == 0
