"""Near-duplicate vectors by product quantisation.

Coarse centroids part the vectors into inverted lists; what a vector is off its centroid is coded by the nearest
codeword in each of several subspaces. A query probes lists by distance, sums table entries for the codes it finds
there (asymmetric distances) and keeps those that the distance, less the known error of the code, can't rule out;
their cosines are then computed exactly in double precision. Centroids and codewords are fitted to a bounded sample;
every vector is indexed and every vector is a query.

Equal vectors are one class and count as often as they come. A link is credited once, to both sides. Lists and the
queries that probe them are cut into blocks, so that no list has to fit one task.

Vectors that are null, zero, or hold null or non-finite components link with nothing: n_links 0, their own component,
kept. So do rows with a null vec_id, whose component is null. Vectors of different length are not compared. Rows that
share a vec_id are one node of the graph; each counts as a link of the others. Empty tables give empty results. Other
columns (labels) are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored, table
from millrace.llm.components import components, roots

COSINE = 0.9
#: Vectors that the index is fitted to, at most.
SAMPLE = 20_000
SUBSPACES = 8
CODEWORDS = 64
#: Lists that a query probes at least, and how much farther (in squared distance) than the nearest a list may be.
PROBES = 8
MARGIN = 0.25
MOST_LISTS = 1024
BLOCK = 2048


@dataclass
class Index:
    centroids: np.ndarray
    codewords: list[np.ndarray]
    cuts: list[int]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, self.cuts, axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's list, codes and the distance between it and what they stand for."""
        at = distances(x, self.centroids).argmin(1)
        off = self.parts(x - self.centroids[at])
        codes = np.stack([distances(o, c).argmin(1) for o, c in zip(off, self.codewords, strict=True)], 1).astype(np.uint8)
        error = sum(((o - c[k]) ** 2).sum(1) for o, c, k in zip(off, self.codewords, codes.T, strict=True))
        return at, codes, np.sqrt(error)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        d = distances(x, self.centroids)
        order = np.argsort(d, 1)
        near = np.take_along_axis(d, order, 1)
        n = np.maximum((near <= near[:, :1] + MARGIN).sum(1), min(PROBES, d.shape[1]))
        return [np.sort(o[:k]) for o, k in zip(order, n, strict=True)]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from k random rows; a centroid without rows stays."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = distances(x, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def fitted(sample: np.ndarray, lists: int) -> Index:
    centroids = means(sample, lists, 6, 1)
    off = sample - centroids[distances(sample, centroids).argmin(1)]
    width = -(-sample.shape[1] // SUBSPACES)
    cuts = list(range(width, sample.shape[1], width))
    return Index(centroids, [means(p, CODEWORDS, 6, 2 + i) for i, p in enumerate(np.split(off, cuts, axis=1))], cuts)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, units, dims = [], [], []
        for v in batch["v"]:
            x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
            top = np.abs(x).max() if x is not None and len(x) and np.isfinite(x).all() else 0
            if top > 0:
                x = x / top  # so that squares neither overflow nor vanish
                x = x / np.sqrt((x * x).sum())
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if top > 0 else None)
            units.append(x.tobytes() if top > 0 else None)
            dims.append(len(x) if top > 0 else 0)
        yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "key": keys, "unit": units, "dim": dims})


def _tile(queries: pd.DataFrame, members: pd.DataFrame, index: Index, cosine: float) -> pd.DataFrame:
    """Links between queries that probe a list and vectors in it: sums of what each gains, and a forest of edges."""
    empty = pd.DataFrame({"kind": [], "a": [], "b": []}).astype({"kind": "int32", "a": "int64", "b": "int64"})
    if not len(queries) or not len(members):
        return empty
    place = int(members["list"].iloc[0])
    x = np.frombuffer(b"".join(members["unit"]), np.float64).reshape(len(members), -1)
    codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1)
    ids, weight, error = members["cid"].to_numpy(), members["w"].to_numpy(), members["error"].to_numpy()
    probes = members["probes"].tolist()
    reach = np.sqrt(2 - 2 * cosine)
    gains: list[tuple[np.ndarray, np.ndarray]] = []
    a, b = [], []
    for low in range(0, len(queries), 256):
        part = queries.iloc[low : low + 256]
        q = np.frombuffer(b"".join(part["q_unit"]), np.float64).reshape(len(part), -1)
        mine, w = part["q_cid"].to_numpy(), part["q_w"].to_numpy()
        near = np.zeros((len(q), len(x)), np.float32)
        for o, words, k in zip(index.parts(q - index.centroids[place]), index.codewords, codes.T, strict=True):
            near += distances(o, words).astype(np.float32)[:, k]
        i, j = np.nonzero(np.sqrt(near) <= reach + error + 1e-3)
        for s in range(0, len(i), 100_000):
            ii, jj = i[s : s + 100_000], j[s : s + 100_000]
            keep = ((q[ii] * x[jj]).sum(1) >= cosine) & (mine[ii] != ids[jj])
            ii, jj = ii[keep], jj[keep]
            # Where the other one's query finds the pair too, the smaller one has it.
            once = (mine[ii] < ids[jj]) | np.array([p not in probes[k] for p, k in zip(part["q_list"].to_numpy()[ii], jj, strict=True)], bool)
            ii, jj = ii[once], jj[once]
            if len(ii):
                gains += [(mine[ii], weight[jj]), (ids[jj], w[ii])]
                nodes, root = roots(mine[ii], ids[jj])
                a.append(nodes[nodes != root])
                b.append(root[nodes != root])
    if not gains:
        return empty
    who, at = np.unique(np.concatenate([g[0] for g in gains]), return_inverse=True)
    total = np.bincount(at, np.concatenate([g[1] for g in gains])).astype(np.int64)
    nodes, root = roots(np.concatenate(a), np.concatenate(b))
    keep = nodes != root
    return pd.DataFrame({"kind": np.r_[np.zeros(len(who), np.int32), np.ones(keep.sum(), np.int32)], "a": np.r_[who, nodes[keep]], "b": np.r_[total, root[keep]]})


def _found(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(kind, a, b) of the classes of one length: kind 0, class a gains b links; kind 1, an edge."""
    spark = classes.sparkSession
    mine = classes.filter(F.col("dim") == dim)
    n = mine.count()
    sample = mine.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("unit").toPandas()["unit"]
    index = fitted(np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), dim), max(1, min(MOST_LISTS, round(n**0.5), len(sample))))
    held = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch["unit"]), np.float64).reshape(len(batch), -1)
            at, codes, error = held.value.encode(x)
            yield batch[["cid", "w", "unit"]].assign(list=at, codes=[c.tobytes() for c in codes], error=error, probes=held.value.probes(x))

    placed = stored(mine.select("cid", "w", "unit").mapInPandas(place, "cid long, w long, unit binary, list int, codes binary, error double, probes array<int>"), "placed")
    probed = placed.withColumn("at", F.explode("probes"))
    # One row per list, of which there are at most MOST_LISTS.
    members = {r[0]: -(-r[1] // BLOCK) for r in placed.groupBy("list").count().collect()}
    asked = {r[0]: -(-r[1] // (2 * BLOCK)) for r in probed.groupBy("at").count().collect()}
    sizes = F.broadcast(spark.createDataFrame([(k, v, asked.get(k, 1)) for k, v in members.items()], "l int, mb int, qb int"))
    m = placed.join(sizes, F.col("list") == F.col("l")).withColumn("m", F.pmod(F.xxhash64("cid"), "mb").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    q = probed.drop("codes", "error", "probes").join(sizes, F.col("at") == F.col("l")).withColumn("q", F.pmod(F.xxhash64("cid"), "qb").cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))

    def tile(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        return _tile(queries, vectors, held.value, cosine)

    # New names, as both sides come from one table.
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in ("l", "m", "q", "cid", "w", "unit", "list")])
    return q.groupBy("q_l", "q_m", "q_q").cogroup(m.groupBy("l", "m", "q")).applyInPandas(tile, "kind int, a long, b long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    rows = stored(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v")).mapInPandas(_units, "vec_id long, key binary, unit binary, dim int"), "units")
    known = rows.filter("vec_id is not null and key is not null")
    # Equal vectors have equal bytes, so any of them will do.
    classes = stored(known.groupBy("key").agg(F.min("vec_id").alias("cid0"), F.count(F.lit(1)).alias("w"), F.first("unit").alias("unit"), F.first("dim").alias("dim")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = None
    for (dim,) in classes.select("dim").distinct().collect():  # lengths of vectors: as a rule one
        part = _found(classes, dim, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stored(found, "found")
    gains = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("more"))
    # Components are of vec_ids: classes by their smallest, and all ids of a class by one another.
    names = classes.select("cid", "cid0")
    edges = found.filter("kind = 1").join(names.withColumnsRenamed({"cid": "a", "cid0": "x"}), "a").join(names.withColumnsRenamed({"cid": "b", "cid0": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = known.join(classes.filter("w > 1").select("key", "cid0"), "key").select(F.col("vec_id").alias("a"), F.col("cid0").alias("b")).filter("a <> b")
    linked = components(edges.filter("a <> b").union(same))
    info = classes.join(gains, classes["cid"] == gains["a"], "left").select("key", (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("n"))
    out = rows.join(info, "key", "left").join(linked, F.col("vec_id") == F.col("node"), "left")
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("n")), F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("vec_id") == root, F.lit(False)).alias("kept"))


def op5_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_pq": op5_pq}
ORACLE: dict[str, str] = {}
