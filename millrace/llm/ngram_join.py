"""Self-join of documents by the Jaccard similarity of their word shingles, exact, and the groups it links.

Equal sets are one class. A class posts the first part of its shingles in an order in which those that a sample
shows often come last (any order is right; this one keeps groups small): two sets that are similar enough share a
posted shingle. Within a posted shingle, classes are tiled by size, and a bitmap of parities bounds the overlap of
two sets from above: each differing bit is an element that only one has. Pairs that the bound lets pass are linked
to a forest; the classes of each tree come together once, with their sorted arrays, and the exact intersection
decides. A pair is only left out if both are already in one group.

Shingles that come with more classes than a tile holds are cut into blocks, and so are large trees; each pair of
blocks is a tile of its own.

Nulls: a null text has no shingles and links with nothing; a null doc_id is an input of no group and its component
is null. Rows with the same doc_id are one node. Empty tables give empty results. Other columns are not read.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held, join_small, stored, table
from millrace.llm.components import components

WORDS = 4
PERCENT = 85
#: Bits of the least bitmap; a set has the next power of two from its size, so that chance differences always show.
LEAST_BITS = 128
TILE = 1500
#: Documents whose shingles tell which ones are frequent.
SAMPLE = 8000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = WORDS, known: dict | None = None) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``size`` words, in lower case; of all words if there are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * PRIME
            out ^= out >> np.uint64(29)
    return np.unique(out)


def bitmap(values: np.ndarray) -> bytes:
    """Parities of the counts of elements by the last bits of their hashes."""
    width = max(LEAST_BITS, 1 << (len(values) - 1).bit_length())
    odd = (np.bincount((values & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


class Bitmaps:
    """Bitmaps of several widths. Parities add, so halves laid over each other are the bitmap of half the width."""

    def __init__(self, column):
        column = list(column)
        self.width = np.array([len(b) for b in column])
        self.rows: dict[int, np.ndarray] = {}
        for w in sorted(set(self.width.tolist()), reverse=True):
            own = np.flatnonzero(self.width >= w)
            found = np.zeros((len(column), w // 8), np.uint64)
            wider = next((x for x in sorted(self.rows) if x > w), None)
            if wider:
                folded = self.rows[wider]
                while folded.shape[1] * 8 > w:
                    half = folded.shape[1] // 2
                    folded = folded[:, :half] ^ folded[:, half:]
                found[own] = folded[own]
            exact = np.flatnonzero(self.width == w)
            found[exact] = np.frombuffer(b"".join(column[i] for i in exact), np.uint64).reshape(len(exact), -1)
            self.rows[w] = found

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the bitmaps of i and j differ, at the lesser of their widths."""
        least = np.minimum(self.width[i], self.width[j])
        out = np.empty(len(least), np.int64)
        for w in set(least.tolist()):
            k = np.flatnonzero(least == w)
            out[k] = np.bitwise_count(self.rows[w][i[k]] ^ self.rows[w][j[k]]).sum(1, dtype=np.int64)
        return out


def needed(a, b, percent: int = PERCENT):
    """The least intersection of sets of sizes a and b that are similar enough: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def posted(values: np.ndarray, often: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The part of a set of which two similar sets share an element: rare first, then by hash."""
    n = len(values) - -(-percent * len(values) // 100) + 1
    if len(often[0]):
        at = np.searchsorted(often[0], values)
        at[at == len(often[0])] = 0
        seen = np.where(often[0][at] == values, often[1][at], 0)
        return values[np.lexsort((values, seen))[:n]]
    return values[:n]


def _set_rows(docs: DataFrame, often, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, posts, bits) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ngram_join")
        for batch in batches:
            n, keys, posts, bits = [], [], [], []
            for x in batch.column(1):
                s = shingles(x.as_py(), size)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                posts.append(posted(s, shared.value, percent).view(np.int64) if len(s) else [])
                bits.append(bitmap(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(posts, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "set_key", "posts", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, posts array<long>, bits binary")


def frequent(docs: DataFrame, size: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come in three or more of about ``sample`` documents, with how many; orders postings, decides nothing."""
    every = max(1, docs.count() // sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held("ngram_join")
        for batch in batches:
            found = [shingles(x, size) for x in batch["t"]]
            values, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), [])
            yield pd.DataFrame({"h": values.view(np.int64), "n": n})

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("text").alias("t"))
    counted = some.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 2").toPandas()
    h = counted["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], counted["n"].to_numpy(np.int64)[order]


def possible(n: np.ndarray, bits: Bitmaps, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs may be similar enough by size and bitmap."""
    most = np.minimum(np.minimum(n[i], n[j]), (n[i] + n[j] - bits.differ(i, j)) // 2)
    return most >= needed(n[i], n[j], percent)


def forest(place: np.ndarray, ids: np.ndarray, n: np.ndarray, bits: Bitmaps, percent: int) -> list[tuple[int, int]]:
    """Edges that span the graph of possible pairs of some places: from each one reached to those not reached yet."""
    left, out = place[np.argsort(n[place], kind="stable")], []
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            low, high = np.searchsorted(n[left], (-(-n[i] * percent // 100), n[i] * 100 // percent + 1))
            js = left[low:high]
            hit = possible(n, bits, np.full(len(js), i), js, percent)
            if hit.any():
                new = js[hit]
                out += [(int(ids[i]), int(ids[j])) for j in new]
                reached += new.tolist()
                left = np.concatenate([left[:low], js[~hit], left[high:]])
    return out


def _tiles(key: list[str], percent: int):
    """For sorted partitions: edges of each group of rows that agree in ``key``. Groups go on over batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            frame = batch if rest is None else rest if batch is None else pd.concat([rest, batch], ignore_index=True)
            if frame is None or not len(frame):
                continue
            values = frame[key].to_numpy()
            starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(1)])
            if batch is not None:  # the last group may go on
                rest, frame, starts = frame.iloc[starts[-1] :].reset_index(drop=True), frame.iloc[: starts[-1]], starts[:-1]
            else:
                rest = None
            if not len(frame):
                continue
            ids, n, bits = frame["cid"].to_numpy(), frame["n"].to_numpy(), Bitmaps(frame["bits"])
            stops = np.r_[starts[1:], len(frame)]
            pairs = starts[stops - starts == 2]
            good = pairs[possible(n, bits, pairs, pairs + 1, percent)]
            out = [pd.DataFrame({"a": ids[good], "b": ids[good + 1]})]
            more = [e for s, t in zip(starts, stops, strict=True) if t - s > 2 for e in forest(np.arange(s, t), ids, n, bits, percent)]
            if more:
                out.append(pd.DataFrame(more, columns=["a", "b"]))
            both = pd.concat(out)
            low = np.minimum(both["a"], both["b"])
            yield pd.DataFrame({"a": low, "b": both["a"] + both["b"] - low}).drop_duplicates()

    return run


def _blocked(df: DataFrame, count: str, size: int, key) -> DataFrame:
    """Rows with ``tile``: a group of more than ``size`` rows is cut into blocks, and a row goes to each pair of blocks
    that has its own."""
    blocks = F.ceil(F.col(count) / size).cast("int")
    own = F.pmod(F.xxhash64(key), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    return df.withColumn("tile", F.explode(F.transform(others, lambda j: F.least(own, j) * blocks + F.greatest(own, j))))


def links(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, cid), cid naming the row's class, and edges (a, b) between classes that are similar
    enough: enough of them that the groups are those of all links."""
    sets = stored(_set_rows(docs, frequent(docs, size), size, percent), "sets")
    known = sets.filter("set_key is not null and doc_id is not null")
    # A set's posts and bitmap are those of any row that has it.
    first = stored(known.groupBy("set_key").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n"), F.first("posts").alias("posts"), F.first("bits").alias("bits")), "classes")
    posts = first.select(F.explode("posts").alias("h"), "cid")
    counted = posts.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    shared = posts.join(counted, "h").join(first.select("cid", "n", "bits"), "cid")
    tiles = stored(_blocked(shared, "times", TILE, "cid").select("h", "tile", "cid", "n", "bits"), "posts")
    near = tiles.repartition("h", "tile").sortWithinPartitions("h", "tile").mapInPandas(_tiles(["h", "tile"], percent), "a long, b long").distinct()
    trees = stored(components(stored(near, "near")), "trees")
    return sets.join(first.select("set_key", "cid"), "set_key", "left").select("doc_id", "n_shingles", "cid"), _verified(docs, trees, size, percent)


def _verified(docs: DataFrame, trees: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges found by exact intersection within each tree of possible pairs."""
    sizes = trees.groupBy("component").agg(F.count(F.lit(1)).alias("times"))
    members = stored(trees.join(sizes, "component"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").alias("t"))
    mine = join_small(texts, members.withColumnRenamed("node", "cid"), F.col("node") == F.col("cid"), "inner", members.count(), 1_000_000)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"component": batch["component"], "times": batch["times"], "cid": batch["cid"], "set": [shingles(t, size).tobytes() for t in batch["t"]]})

    # Small trees share a bin; blocks of large ones are tiles.
    rows = _blocked(mine.select("component", "times", "cid", "t").mapInPandas(sets, "component long, times long, cid long, set binary"), "times", TILE // 3, "cid")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in itertools.chain(batches, [None]):
            frame = batch if rest is None else rest if batch is None else pd.concat([rest, batch], ignore_index=True)
            if frame is None or not len(frame):
                continue
            values = frame[["component", "tile"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(1)])
            if batch is not None:
                rest, frame, starts = frame.iloc[starts[-1] :].reset_index(drop=True), frame.iloc[: starts[-1]], starts[:-1]
            if not len(frame):
                continue
            stops = np.r_[starts[1:], len(frame)]
            out = [e for s, t in zip(starts, stops, strict=True) for e in joined(frame["cid"].to_numpy()[s:t], [np.frombuffer(x, np.uint64) for x in frame["set"].iloc[s:t]], percent)]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return rows.repartition("component", "tile").sortWithinPartitions("component", "tile").mapInPandas(exact, "a long, b long")


def joined(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges between similar sets, a spanning forest of them: exact, each node reached against those not reached yet."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    ids, sets, n = ids[order], [sets[i] for i in order], n[order]
    bits = Bitmaps(map(bitmap, sets))
    left, out = np.arange(len(ids)), []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            low, high = np.searchsorted(n[left], (-(-n[i] * percent // 100), n[i] * 100 // percent + 1))
            js = left[low:high]
            may = possible(n, bits, np.full(len(js), i), js, percent)
            hit = np.zeros(len(js), bool)
            for k in np.flatnonzero(may):
                other = sets[js[k]]
                at = np.searchsorted(sets[i], other)
                at[at == n[i]] = 0
                same = int((sets[i][at] == other).sum())
                hit[k] = same >= needed(int(n[i]), len(other), percent)
            new = js[hit]
            out += [(int(ids[i]), int(ids[j])) for j in new]
            reached += new.tolist()
            left = np.concatenate([left[:low], js[~hit], left[high:]])
    return out


def groups(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach."""
    rows, edges = links(docs, size, percent)
    found = components(stored(edges, "links"))
    out = rows.join(found, rows["cid"] == found["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "cid", "doc_id").alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLE: dict[str, str] = {}
