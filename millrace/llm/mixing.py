"""Mixing of sources to target weights.

The words of each source are packed, document after document, into blocks of a fixed length. The targets
of the sources give how many blocks each must yield; these slots are dealt to output shards by a
multinomial draw that keeps the totals: the draw is split in halves again and again (multivariate
hypergeometric), each split seeded by its place, so that every shard finds its own counts, and where they
start in each source's sequence of slots, without any other shard. Slot number k of a source shows block
k mod N of pass k div N, through a pseudorandom permutation of 0..N-1 of its own for each source and pass.
Slots and blocks are joined by source and block number.

The last slot of a source is cut so that the source yields its target to the word.

Nulls: a null text has no words; documents of a null source are a source of their own, which comes last;
a null doc_id stays. Equal rows are interchangeable and each counts. Empty tables give empty results; if
no text has words, nothing is taken. Other columns are only carried; those named size or first are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import held, stored, table, words

BLOCK = 512
SHARD = 1024
MOST = 3
#: Rows that are put in order together; sums of these are put in order by source.
CHUNK = 2_000
#: Sources up to which the plan is joined by broadcast.
SOURCES = 10_000


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; a share stops at ``most`` times its size, the rest is shared again."""
    total, found, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(found[i] for i in range(len(sizes)) if i not in free)
        scale = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / scale for i in free}
        full = {i for i in free if share[i] > most * sizes[i]}
        for i in full or free:
            found[i] = float(most * sizes[i]) if full else share[i]
        free = free - full if full else set()
    return found


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of the splitmix generator)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rounds(n: int, key: int) -> tuple[np.uint64, np.uint64, list[np.uint64]]:
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    return half, np.uint64((1 << int(half)) - 1), [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1)) for r in range(4)]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network on the next even number of bits, walked until inside."""
    half, mask, keys = _rounds(n, key)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            x = out[todo]
            left, right = x >> half, x & mask
            for k in keys:
                left, right = right, left ^ (mixed_bits(right ^ k) & mask)
            out[todo] = left << half | right
            todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def index_of(value: int, n: int, key: int) -> int:
    """Which index ``permuted`` takes to a value: the rounds backwards, walked until inside."""
    half, mask, keys = _rounds(n, key)
    x = np.array([value], np.uint64)
    with np.errstate(over="ignore"):
        while True:
            left, right = x >> half, x & mask
            for k in reversed(keys):
                left, right = right ^ (mixed_bits(left ^ k) & mask), left
            x = left << half | right
            if x[0] < n:
                return int(x[0])


def drawn(count: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among ``size`` drawn without replacement from ``count`` of each, at any size: each is
    taken with the same chance, and then single ones, of which there are about the root of all, are added or put back."""
    total = int(count.sum())
    if not total:
        return np.zeros_like(count)
    taken = rng.binomial(count, size / total)
    more = size - int(taken.sum())
    pool = count - taken if more > 0 else taken
    single = rng.choice(int(pool.sum()), abs(more), replace=False, shuffle=False) if more else np.empty(0, np.int64)
    change = np.bincount(np.searchsorted(np.cumsum(pool), single, "right"), minlength=len(count))
    return taken + change if more > 0 else taken - change


def shard_draw(totals: np.ndarray, shards: int, slots: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per source: where the shard's slots start in the source's sequence, and how many it has."""
    start, count, low, high = np.zeros_like(totals), totals.copy(), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        size = min((middle - low) * slots, int(count.sum()))
        left = drawn(count, size, np.random.default_rng([seed, low, high]))
        if shard < middle:
            count, high = left, middle
        else:
            start, count, low = start + left, count - left, middle
    return start, count


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __size, the number of words, and __id, a hash of doc_id and text; without columns of these names."""
    return docs.withColumn("__size", F.size(words(F.col(text))).cast("long")).withColumn("__id", F.xxhash64("doc_id", text))


def numbered(rows: DataFrame) -> DataFrame:
    """A stored copy of the rows with __row, a number of each."""
    return stored(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def places(rows: DataFrame, source: str = "source") -> DataFrame:
    """Of numbered, sized rows: (row, source, size, first); first is the row's place in its source's sequence of words.

    The order within a source is by a hashed chunk, then doc_id and text; chunks are summed first, so that a large
    source is put in order by many tasks. Texts don't take part.
    """
    chunks = max(1, -(-rows.count() // CHUNK))
    light = rows.select(F.col("__row").alias("row"), F.col(source).alias("source"), F.col("__size").alias("size"), "doc_id", F.col("__id").alias("id"), F.pmod("__id", F.lit(chunks)).alias("chunk"))
    sums = light.groupBy(F.col("source").alias("s"), F.col("chunk").alias("c")).agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    within = Window.partitionBy("source", "chunk").orderBy("doc_id", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    inside = light.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = inside.join(before, inside["source"].eqNullSafe(before["s"]) & (inside["chunk"] == before["c"]), "left")
    return joined.select("row", "source", "size", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("first"))


def placed(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Each row's columns with size, and first: its place in its source's sequence of words."""
    rows = numbered(sized(docs, text))
    found = places(rows, source).select(F.col("row").alias("__row"), F.col("size").alias("__s"), F.col("first").alias("__f"))
    own = [c for c in docs.columns if c not in ("size", "first")]
    return rows.join(found, "__row").select(*own, F.col("__s").alias("size"), F.col("__f").alias("first"))


def plan_of(rows: DataFrame, source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = MOST, block: int = BLOCK) -> list[dict]:
    """One entry per source, by code point, null last: number, size, target, slots. As many as there are sources."""
    found = rows.groupBy(source).agg(F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [r["size"] for r in found]
    plan = []
    for i, (r, target) in enumerate(zip(found, targets(sizes, [weights[k % len(weights)] for k in range(len(found))], most), strict=True)):
        n, size, aim = r["size"], -(-r["size"] // block), min(round(target), int(most * r["size"]))
        passes, rest = divmod(aim, n) if n else (0, 0)
        plan.append({"number": i, "source": r[0], "size": n, "target": target, "blocks": size, "passes": passes, "rest": rest, "slots": passes * size + -(-rest // block)})
        if rest:  # the last block of a source may be short: if it comes before the cut, one more slot is needed
            slots, short = -(-rest // block), block - (n - (size - 1) * block)
            if index_of(size - 1, size, _key(0, i, passes)) < slots and slots * block - short < rest:
                plan[-1]["slots"] += 1
    return plan


def _key(seed: int, number: int, turn: int) -> int:
    return ((seed * 1_000_003 + number) * 1_000_003 + turn) & (2**63 - 1)


def slots_of(spark: SparkSession, plan: list[dict], block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """Rows (shard, slot, number, turn, block, words): which block fills each slot of each shard, cut to ``words``."""
    totals = np.array([p["slots"] for p in plan], np.int64)
    shards = max(1, -(-int(totals.sum()) // shard))
    shared = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("mixing")
        for batch in batches:
            for s in batch["id"]:
                start, count = shard_draw(totals, shards, shard, int(s), seed)
                parts = []
                for p, a, c in zip(shared.value, start, count, strict=True):
                    if not c:
                        continue
                    k = np.arange(a, a + c)
                    turn, at, n = k // p["blocks"], k % p["blocks"], p["blocks"]
                    index = np.empty(len(k), np.int64)
                    for t in np.unique(turn):
                        index[turn == t] = permuted(at[turn == t], n, _key(0, p["number"], int(t)))
                    size = np.where(index == n - 1, p["size"] - (n - 1) * block, block)
                    last = k == p["slots"] - 1
                    if p["rest"] and last.any():  # the blocks before it in its pass are whole, but for a short one
                        m = int(at[last][0])
                        short = index_of(n - 1, n, _key(0, p["number"], p["passes"])) < m
                        taken = m * block - (block - (p["size"] - (n - 1) * block)) * short
                        size = np.where(last, np.minimum(size, p["rest"] - taken), size)
                    parts.append(pd.DataFrame({"number": p["number"], "turn": turn, "block": index, "words": size}))
                if parts:
                    out = pd.concat(parts).sample(frac=1, random_state=np.random.default_rng([seed, 7, int(s)]))
                    yield out.assign(shard=int(s), slot=np.arange(len(out)))[["shard", "slot", "number", "turn", "block", "words"]]

    return spark.range(0, shards, 1, min(shards, 2000)).mapInPandas(run, "shard long, slot long, number int, turn int, block long, words long")


def mixture(rows: DataFrame, plan: list[dict], source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """What fills each slot: rows (shard, slot, number, turn, block, first, from_word, n_words), a row for each
    document with words in the slot's block; the document is the one of its source whose words start at ``first``.

    Slots grow with the corpus, whatever the planner takes them for, so they are joined by a shuffle."""
    spark = rows.sparkSession
    mine = rows.filter("size > 0").select(F.col(source).cast("string").alias("__s"), "first", "size")
    numbered = with_plan(mine, "__s", plan, ("number",)).drop("__s")
    cut = numbered.withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("first") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("first"), F.col("block") * block)
    high = F.least(F.col("first") + F.col("size"), F.col("block") * block + F.col("words"))
    joined = slots_of(spark, plan, block, shard, seed).hint("merge").join(cut, ["number", "block"])
    return joined.select("shard", "slot", "number", "turn", "block", "first", (low - F.col("first")).alias("from_word"), (high - low).alias("n_words")).filter("n_words > 0")


def with_plan(rows: DataFrame, source: str, plan: list[dict], fields: tuple[str, ...]) -> DataFrame:
    """Rows with fields of their source's plan."""
    kinds = {"number": "int", "size": "long", "target": "double"}
    named = rows.sparkSession.createDataFrame([(p["source"], *(p[f] for f in fields)) for p in plan], "__name string, " + ", ".join(f"`{'source_size' if f == 'size' else f}` {kinds[f]}" for f in fields))
    return rows.join(F.broadcast(named) if len(plan) <= SOURCES else named.hint("merge"), F.col(source).eqNullSafe(F.col("__name"))).drop("__name")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    light = numbered(sized(docs).drop("text"))
    rows = stored(places(light), "placed")
    plan = plan_of(rows)
    taken = mixture(rows, plan).groupBy("number", "first").agg(F.sum("n_words").alias("taken"))
    ids = light.select(F.col("__row").alias("row"), "doc_id")
    own = with_plan(rows, "source", plan, ("number", "size", "target")).join(ids, "row")
    # A document without words shares its place with the next one, and takes nothing.
    joined = own.withColumn("n", F.when(F.col("size") > 0, F.col("number"))).join(taken.withColumnRenamed("number", "n"), ["n", "first"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


QUERIES = {"op2_mixing": op2_mixing}
ORACLE: dict[str, str] = {}
