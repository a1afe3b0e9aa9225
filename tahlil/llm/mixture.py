"""Problem 8: a mixture of sources in which each takes its target share of the tokens.

1. Every text is encoded once (problem 7). Each task packs the tokens of a source, document behind document in
   pseudorandom order within a batch, into blocks of BLOCK tokens, without an exchange. What is left at the end of a task
   is packed across tasks: the remainders of a source are laid end to end by their running sums and cut
   into blocks again. So of all blocks of a source only the last is short.
2. The goal of a source is a number of tokens: its weight times the greatest total at which no source needs more than its
   tokens times `max_repeats`. It is given out as slots, one block each; the last slot of a source takes only as
   many tokens as are left of its goal. So the shares are exact to the token.
3. The slots are dealt to output shards of SHARD_SLOTS. Each shard draws its counts by source multinomially, conditioned
   on the totals: the shards are halved again and again, and the slots of a half are drawn for its
   first half. A shard follows only its own halves, so shards may be any number.
4. A slot's rank within its source goes through a pseudorandom permutation of the source's block numbers,
   another one for each round of repetition; blocks join their slots by number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tahlil.llm.tokens import encoded, sent_table, tokenizer, tokenizer_path
from tahlil.session import written

BLOCK = 512  # tokens in a block
SHARD_SLOTS = 4_096  # slots of an output shard; the last may have fewer
SOURCES_MOST = 10_000  # most rows of the table of targets
SEED = 17

MIX = "shard long, slot long, source string, block long, copy int, n_tokens int, docs array<struct<doc_id:bigint,begin:int,n:int>>, ids array<int>"
PACKED = "source string, part int, k long, n int, docs array<struct<doc_id:bigint,begin:int,n:int>>, ids binary"
DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("begin", pa.int32()), ("n", pa.int32())]))


def permuted(x: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(size), chosen by `key`, at the places x; elementwise.

    Four Feistel rounds over the next power of four, walked until the value falls below `size`.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.ones(len(x), bool)
    while todo.any():
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = v >> h, v & m
        for r in range(4):
            f = (right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r + 1) * 0xBF58476D1CE4E5B9 % 2**64)).astype(np.uint64)
            f = (f ^ (f >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, (left ^ (f ^ (f >> np.uint64(31)))) & m
        out[todo] = (left << h) | right
        todo = out >= size.astype(np.uint64)
    return out.astype(np.int64)


def targets(sources: pd.DataFrame, block: int = BLOCK) -> pd.DataFrame:
    """`goal` (tokens) and `slots` of each source: as many tokens in all as the scarcest source allows.

    `sources`: source, weight, max_repeats, tokens; a source of weight 0 or without tokens takes none, and
    the weights of the others are used as they are. The last slot has `last` tokens.
    """
    s = sources[(sources.weight > 0) & (sources.tokens > 0) & (sources.max_repeats > 0)].copy()
    if s.empty:
        return s.assign(goal=pd.Series(dtype=np.int64), slots=pd.Series(dtype=np.int64), last=pd.Series(dtype=np.int64), blocks=pd.Series(dtype=np.int64))
    most = s.tokens * s.max_repeats
    weight = s.weight / s.weight.sum()
    goal = np.minimum(np.floor(weight * (most / weight).min() + 1e-6).astype(np.int64), most)
    blocks = -(-s.tokens // block)
    rest = goal % s.tokens
    more = -(-rest // block)
    last = np.where(rest > 0, rest - block * (more - 1), s.tokens - block * (blocks - 1))
    return s.assign(goal=goal, blocks=blocks, slots=goal // s.tokens * blocks + more, last=last)


def drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. Beyond what the exact generator can do, by the normal distribution of
    the same mean and variance."""
    total = good + bad
    if total < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    p = good / total
    x = round(n * p + (n * p * (1 - p) * (total - n) / (total - 1)) ** 0.5 * rng.standard_normal())
    return int(min(max(x, 0, n - bad), n, good))


@lru_cache(4_096)
def halved(slots: tuple[int, ...], n: int, low: int, high: int, seed: int) -> tuple[int, ...]:
    """What the first n of some slots have of each source."""
    rng, left, out = np.random.default_rng([seed, low, high]), sum(slots), []
    for s in slots[:-1]:
        out.append(drawn(rng, s, left - s, n) if n else 0)
        left, n = left - s, n - out[-1]
    return (*out, n)


def shard_counts(slots: tuple[int, ...], shard: int, size: int = SHARD_SLOTS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard its slots of each source, and those of the shards before it."""
    low, high = 0, -(-sum(slots) // size)
    before = np.zeros(len(slots), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        first = halved(slots, (middle - low) * size, low, high, seed)
        if shard < middle:
            slots, high = first, middle
        else:
            before += first
            slots, low = tuple(a - b for a, b in zip(slots, first, strict=True)), middle
    return np.array(slots, np.int64), before


def dealt(goal: pd.DataFrame, shard: int, seed: int = SEED, size: int = SHARD_SLOTS) -> pd.DataFrame:
    """The slots of a shard: slot, source (its number), block, copy, and how many tokens it takes (-1: the whole block).

    The last block of a source, which may be short, stands last in each round, so that the tokens of a round are known.
    """
    counts, before = shard_counts(tuple(map(int, goal.slots)), shard, size, seed)
    held, slots, last = (goal[c].to_numpy(np.int64) for c in ("blocks", "slots", "last"))
    s = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(s)) - np.repeat(np.cumsum(counts) - counts, counts) + before[s]
    copy, x = rank // held[s], rank % held[s]
    block = x.copy()
    full = x < held[s] - 1
    block[full] = permuted(x[full], held[s][full] - 1, (seed + 1_000 * s + copy)[full])
    slot = permuted(np.arange(len(s)), np.full(len(s), len(s)), np.full(len(s), seed + 7_000_003 + shard))
    return pd.DataFrame({"shard": np.full(len(s), shard, np.int64), "slot": slot, "s": s, "block": block, "copy": copy.astype(np.int32), "take": np.where(rank == slots[s] - 1, last[s], -1).astype(np.int32)})


def wide(path: str) -> str:
    """The type of a packed id: two bytes if all ids of the tokenizer fit, else four."""
    return "<u2" if tokenizer(path).get_vocab_size() <= 0x10000 else "<u4"


class Packer:
    """Packs the documents of a task, source by source; what does not fill a block waits for the next batch."""

    def __init__(self, block: int, kind: str):
        self.block, self.kind = block, kind
        self.ids: dict[str, np.ndarray] = {}
        self.docs: dict[str, list[tuple]] = {}
        self.made: dict[str, int] = {}

    def batch(self, b: pa.RecordBatch) -> list[tuple]:
        """(source, number, tokens, documents, ids) of the blocks that are filled by a batch (doc_id, source, ids)."""
        keys, sources, lists = b.column("doc_id").to_pylist(), b.column("source").to_pylist(), b.column("ids")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        by: dict[str, list[int]] = {}
        mixed = np.array([k or 0 for k in keys], np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in np.argsort(mixed ^ (mixed >> np.uint64(29)), kind="stable").tolist():
            if sizes[i]:
                by.setdefault(sources[i], []).append(i)
        out = []
        for source, some in by.items():
            self.ids[source] = np.concatenate([self.ids.get(source, np.zeros(0, self.kind)), *(flat[ends[i] - sizes[i] : ends[i]] for i in some)]).astype(self.kind)
            self.docs[source] = self.docs.get(source, []) + [(keys[i], 0, int(sizes[i])) for i in some]
            out += self._cut(source, len(self.ids[source]) // self.block)
        return out

    def _cut(self, source: str, n: int) -> list[tuple]:
        """The first n blocks of what waits."""
        ids, docs, block = self.ids[source], self.docs[source], self.block
        out, at, size = [], 0, n * block
        here, left = [], block
        while at < len(docs) and size:
            key, begin, length = docs[at]
            k = min(length, left)
            here.append((key, begin, k))
            left, size = left - k, size - k
            if k < length:
                docs[at] = (key, begin + k, length - k)
            else:
                at += 1
            if not left:
                i = len(out)
                out.append((source, self.made.get(source, 0) + i, block, here, ids[i * block : (i + 1) * block].tobytes()))
                here, left = [], block
        self.ids[source], self.docs[source] = ids[n * block :], docs[at:]
        self.made[source] = self.made.get(source, 0) + n
        return out

    def rest(self) -> list[tuple]:
        """What waits at the end, with -1 for its number."""
        return [(s, -1, len(ids), self.docs[s], ids.tobytes()) for s, ids in self.ids.items() if len(ids)]


def packed(docs: DataFrame, mix: DataFrame, path: str, block: int) -> DataFrame:
    """The blocks of each task, and what is left at its end (k = -1); see PACKED."""
    d = docs.join(F.broadcast(mix.select("source")), "source", "left_semi").select("doc_id", "source", "text")
    sent, kind = sent_table(d, "text", path), wide(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack, part = Packer(block, kind), TaskContext.get().partitionId()

        def rows(some: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*some, strict=True)) or [()] * 5
            pieces = list(zip(*(d for x in c[3] for d in x), strict=True)) or [()] * 3
            where = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c[3])]), pa.int32()), pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(pieces, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "begin", "n"]))
            columns = [pa.array(c[0], pa.string()), pa.array([part] * len(some), pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), where, pa.array(c[4], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["source", "part", "k", "n", "docs", "ids"])

        for b in batches:
            for begin, ids in encoded(b.column("text"), sent, path):
                some = b.slice(begin, len(ids))
                yield rows(pack.batch(pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("source"), ids], names=["doc_id", "source", "ids"])))
        yield rows(pack.rest())

    return written(d.mapInArrow(run, PACKED), "mix")


def blocks(made: DataFrame, block: int, kind: str) -> DataFrame:
    """(source, block, n, docs, ids): the blocks of each source numbered from 0, of which only the last may be short.

    The full blocks of a task follow those of the tasks before it, by sums over the tasks; then come the blocks of the
    remainders. A remainder is shorter than a block, so it falls into two of these at most.
    """
    by = made.groupBy("source", "part").agg(F.count_if(F.col("k") >= 0).alias("full"), F.sum(F.when(F.col("k") < 0, F.col("n")).otherwise(0)).alias("rest"))
    before = "over (partition by source order by part rows between unbounded preceding and 1 preceding)"
    base = written(by.selectExpr("source", "part", f"coalesce(sum(full) {before}, 0) as first", f"coalesce(sum(rest) {before}, 0) as at", "sum(full) over (partition by source) as every"), "mix-parts")
    size = np.dtype(kind).itemsize
    full = made.filter("k >= 0").join(base.select("source", "part", "first"), ["source", "part"]).select("source", (F.col("first") + F.col("k")).alias("block"), "n", "docs", "ids")
    rest = made.filter("k < 0").join(base.select("source", "part", "at", "every"), ["source", "part"])
    cut = F.least(F.col("n"), (F.lit(block) - F.col("at") % block).cast("int"))  # tokens that still fit into the block where it begins
    start = F.expr("transform(sequence(1, size(docs)), i -> aggregate(slice(docs, 1, i - 1), 0, (a, d) -> a + d.n))")
    both = rest.withColumns({"cut": cut, "starts": start})
    part = lambda lo, hi: F.filter(
        F.zip_with("docs", "starts", lambda d, s: F.struct(d["doc_id"].alias("doc_id"), (d["begin"] + F.greatest(lo - s, F.lit(0))).alias("begin"), (F.least(s + d["n"], hi) - F.greatest(s, lo)).alias("n"))),
        lambda d: d["n"] > 0,
    )
    zero, n, c = F.lit(0), F.col("n"), F.col("cut")
    first = F.struct(F.floor(F.col("at") / block).alias("k"), F.col("at").alias("at"), c.alias("n"), part(zero, c).alias("docs"), F.expr(f"substring(ids, 1, cut * {size})").alias("ids"))
    second = F.struct((F.floor(F.col("at") / block) + 1).alias("k"), (F.col("at") + c).alias("at"), (n - c).alias("n"), part(c, n).alias("docs"), F.expr(f"substring(ids, cut * {size} + 1)").alias("ids"))
    pieces = both.select("source", "every", F.explode(F.filter(F.array(first, second), lambda p: p["n"] > 0)).alias("p"))
    whole = pieces.groupBy("source", (F.col("every") + F.col("p.k")).alias("block")).agg(F.sort_array(F.collect_list(F.struct("p.at", "p.n", "p.docs", "p.ids"))).alias("p"))
    joined = whole.select("source", "block", F.expr("aggregate(p, 0, (a, x) -> a + x.n)").alias("n"), F.flatten("p.docs").alias("docs"), F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
    return full.unionByName(joined)


def mixture(docs: DataFrame, mix: DataFrame, path: str | None = None, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix, a row per slot: `shard`, `slot` in the shard, `source`, `block`, which `copy` of the block it
    is (from 0), `n_tokens`, the pieces of documents in the block (`docs`: `begin` and `n` in tokens of the
    document) and the block's `ids`.

    `docs`: doc_id, source, text; documents without source, of a source without target, or without tokens
    stay out. `mix`: source, weight, max_repeats (a bounded table: one row a source, refused beyond SOURCES_MOST; of several the
    greatest weight and the fewest repeats hold; a source without either takes no part). No piece of a document
    appears more often than `max_repeats`. Repeated documents are packed as often as they are stored. Empty
    tables give an empty mix.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    if mix.count() > SOURCES_MOST:
        raise ValueError(f"the table of targets has more than {SOURCES_MOST} rows")
    mix = mix.groupBy("source").agg(F.max("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    made = packed(docs, mix, path, block)
    have = made.groupBy("source").agg(F.sum("n").cast("long").alias("tokens"))
    goal = targets(mix.join(have, "source").select("source", "weight", "max_repeats", "tokens").toPandas().sort_values("source").reset_index(drop=True), block)
    if goal.empty:
        return spark.createDataFrame([], MIX)
    names, kind = goal.source.tolist(), wide(path)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for shard in f.id:
                d = dealt(goal, int(shard), size=shard_slots)
                yield d.assign(source=[names[i] for i in d.s]).drop(columns="s")

    shards = -(-int(goal.slots.sum()) // shard_slots)
    slots = spark.range(0, shards, 1, max(1, min(shards, max(spark.sparkContext.defaultParallelism, shards // 64)))).mapInPandas(deal, "shard long, slot long, block long, copy int, take int, source string")
    joined = blocks(made, block, kind).join(slots.hint("merge"), ["source", "block"])  # both sides grow with the data

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, where = b.column("ids").to_pylist(), b.column("docs")
            n, take = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "take"))
            got = np.where((take >= 0) & (take < n), take, n).astype(np.int64)
            short = np.flatnonzero(got < n)
            if len(short):
                data, lists = list(data), where.to_pylist()
                for i in short.tolist():
                    data[i], left, some = data[i][: int(got[i]) * np.dtype(kind).itemsize], int(got[i]), []
                    for d in lists[i]:
                        if left:
                            some.append(d | {"n": min(left, d["n"])})
                            left -= some[-1]["n"]
                    lists[i] = some
                where = pa.array(lists, DOCS)
            ends = np.concatenate([[0], np.cumsum(got)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), kind).astype(np.int32)))
            columns = {"n_tokens": pa.array(got.astype(np.int32)), "docs": where, "ids": ids}
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else b.column(c) for c in ORDER], names=ORDER)

    return joined.select("shard", "slot", "source", "block", "copy", "n", "take", "docs", "ids").mapInArrow(opened, MIX)


ORDER = ["shard", "slot", "source", "block", "copy", "n_tokens", "docs", "ids"]


def shares(mixed: DataFrame, mix: DataFrame) -> DataFrame:
    """The shares reached: of each source of `mix` its weight, blocks and tokens in the mix, its share of all
    tokens, and the most copies of one block. A source that gives nothing has zeros."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_tokens").alias("tokens"), (F.max("copy") + 1).alias("most_copies"))
    out = F.broadcast(mix.select("source", "weight", "max_repeats")).join(got, "source", "left").fillna(0, ["blocks", "tokens", "most_copies"])
    every = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    return out.select("source", "weight", "max_repeats", "blocks", "tokens", (F.col("tokens") / F.greatest(every, F.lit(1))).alias("share"), "most_copies")
