"""Removal of repeated passages by suffix arrays.

A string of LENGTH bytes that has started before (in a document of smaller doc_id, or earlier in the same one) is
repeated, and every byte that such a string covers is removed.

Each string holds a window's least hash of GRAM bytes, its anchor, at a place that its bytes alone decide; so equal
strings have equal anchors. Anchors that come once can't repeat and are left out: a bitmap of fixed size, or beyond
its capacity a join, tells which come again. The text around the others goes to the shard of its anchor. A shard
drops equal contexts but the first, builds the suffix array of the rest (Larsson and Sadakane's refinement of ranks by
doubling, as far as strings reach), takes the common prefixes of neighbours (Kasai), and so finds classes of equal
strings; all but the first of a class are marked. Contexts of one anchor that don't fit one array are cut into several,
whose sorted strings are merged by binary search. Exact copies of whole texts are set aside before, and rows of one
doc_id and text count once.

An anchor with more than HOT contexts is split: first equal contexts are dropped but one in each of as many salted
groups as its count asks for; then the strings get anchors of more bytes, by the same rule, and each context is cut where
these change. What has more than HOT contexts still is split by anchors of more bytes again, up to all but three of a
string's. Equal strings still meet, as their bytes alone decide each anchor.

Nulls: a null text is empty; a null doc_id comes after all others. Rows of one doc_id and text are one document and
don't repeat each other. Texts below LENGTH bytes lose nothing. Empty tables give empty results. Other columns are not
read.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import join_small, stored, table

LENGTH = 100
GRAM = 24
#: Bits of the map of repeated anchors; with more than a sixteenth of them set, anchors are joined instead.
BITS = 1 << 26
#: Bytes of text that are hashed at a time, and of contexts that one suffix array holds.
CHUNK = 1 << 20
SHARD = 1 << 20
#: Contexts of an anchor beyond which it is split, and bytes of the anchors by which it is, one after the other.
HOT = 2000
FINER = (60, 84, 97)
#: Rows of small tables (some 40 bytes each) up to which they are broadcast.
SMALL = 200_000
LAST = (1 << 63) - 1


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of texts together below CHUNK bytes (or one longer): hash, text, first and last string start of each anchor."""
    gram = min(gram, length)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    none = (np.empty(0, np.int64),) * 4
    if len(data) < length:
        return none
    x = np.zeros(len(data) + 32, np.uint64)
    x[: len(data)] = data
    a = x[:-1] << np.uint64(8) | x[1:]
    a = a[:-2] << np.uint64(16) | a[2:]
    a = a[:-4] << np.uint64(32) | a[4:]
    n = len(data) - gram + 1
    with np.errstate(over="ignore"):
        h = np.full(n, gram, np.uint64)
        for k in range(0, gram, 8):
            part = a[k : k + n] if k + 8 <= gram else a[k : k + n] >> np.uint64(8 * (k + 8 - gram))
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    # Least hash of each window of grams; the place in the low bits makes the leftmost of equal ones the least.
    low = np.uint64(max(1, int(n - 1).bit_length()))
    key = (h >> low << low) | np.arange(n, dtype=np.uint64)
    window, width, least = length - gram + 1, 1, key
    while width * 2 <= window:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: len(least) - (window - width)], least[window - width :])
    at = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(at))
    of = np.searchsorted(ends, start, "right")
    inside = start + length <= ends[of]
    at, start, of = at[inside], start[inside], of[inside]
    if not len(at):
        return none
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    begin = np.r_[0, ends[:-1]]
    shift = begin[of[first]]
    return h[at[first]].view(np.int64), of[first], start[first] - shift, start[last] - shift


SYMBOLS = 7


def leading(s: np.ndarray, more: int = 0) -> np.ndarray:
    """The SYMBOLS symbols from each place on as one number, and zeros for ``more`` places after the end."""
    wide = np.zeros(len(s) + more + SYMBOLS, np.int64)
    wide[: len(s)] = s
    key = np.zeros(len(s) + more, np.int64)
    for k in range(SYMBOLS):
        key = key << 9 | wide[k : k + len(key)]
    return key


def suffix_array(s: np.ndarray, key: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes and, by suffix, the place of the first that has its rank; s: symbols 0 to 256. Ranks by SYMBOLS
    symbols first; then the suffixes of each group of equal rank are refined by the rank as far on as they have been
    compared, until all differ or ``most`` symbols have been compared."""
    n = len(s)
    key = leading(s) if key is None else key[:n]
    order = np.argsort(key)
    by = key[order]
    new = np.r_[True, by[1:] != by[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = SYMBOLS
    open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(open_) and (most is None or depth < most):
        which = order[open_]
        on = which + depth
        both = rank[which] * (n + 1) + np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)
        by = np.argsort(both)
        order[open_] = which = which[by]
        both = both[by]
        new = np.r_[True, both[1:] != both[:-1]]
        rank[which] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.r_[new[1:], True])]
        depth *= 2
    return order, rank


def common_prefixes(key: np.ndarray, order: np.ndarray, rank: np.ndarray, begins: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For the places in the order of the first ``counts`` suffixes of each context: the common prefix with the suffix
    before, up to ``most``. Kasai's pass, in which a suffix has at least one less than the suffix before it in the text,
    runs over all contexts side by side and compares SYMBOLS symbols at a time. Suffixes of one rank agree in ``most``."""
    out = np.zeros(len(order), np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, length, stop = begins.copy(), np.zeros(len(begins), np.int64), begins + counts
    going = np.flatnonzero(counts > 0)
    while len(going):
        i = at[going]
        r = place[i]
        head = rank[i] == r
        j = order[np.maximum(r - 1, 0)]
        size = np.where(head, length[going], most)
        size[r == 0] = 0
        todo = np.flatnonzero(head & (r > 0) & (size < most))
        while len(todo):
            differ = key[i[todo] + size[todo]] ^ key[j[todo] + size[todo]]
            same = differ == 0
            ended = todo[~same]
            size[ended] += sum((differ[~same] < 1 << 9 * k).astype(np.int64) for k in range(1, SYMBOLS))
            todo = todo[same]
            size[todo] += SYMBOLS
            todo = todo[size[todo] < most]
        out[r] = np.minimum(size, most)
        length[going] = np.where(head, np.maximum(np.minimum(size, most) - 1, 0), 0)
        at[going] += 1
        going = going[at[going] < stop[going]]
    return out


def classes(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of a shard: context, place in it and class, in sorted order; strings of a class are equal."""
    sizes = np.array([len(c) + 1 for c in contexts])
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    raw[begins + sizes - 1] = 0
    key = leading(raw, length + SYMBOLS)
    order, rank = suffix_array(raw, key, length)
    lcp = common_prefixes(key, order, rank, begins, sizes - length, length)
    of = np.repeat(np.arange(len(sizes)), sizes)[order]
    place = order - begins[of]
    whole = place + length < sizes[of]
    number = np.cumsum(lcp < length)
    return of[whole], place[whole], number[whole]


def later(contexts: list[bytes], owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, place) of every string that isn't the first of its class; owner: doc_id, text key and start of each
    context (three rows), by which strings are ordered. Contexts are dealt to arrays of at most SHARD bytes."""
    marked: list[tuple[np.ndarray, np.ndarray]] = []
    merged: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    sizes = np.cumsum([len(c) for c in contexts])
    low = 0
    while low < len(contexts):
        done = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + SHARD, "right")))
        of, place, number = classes(contexts[low:high], length)
        of += low
        by = np.lexsort((owner[2][of] + place, owner[1][of], owner[0][of], number))
        of, place, number = of[by], place[by], number[by]
        first = np.r_[True, number[1:] != number[:-1]] if len(of) else np.empty(0, bool)
        marked.append((of[~first], place[~first]))
        if low or high < len(contexts):  # other arrays of this anchor: their strings are found by binary search
            of, place = of[first], place[first]
            strings = np.array([contexts[c][p : p + length] for c, p in zip(of.tolist(), place.tolist(), strict=True)], dtype=np.dtype((np.void, length)))
            alive = np.ones(len(of), bool)
            for others, of_2, place_2, alive_2 in merged:
                at = _search(others, strings)
                x = np.flatnonzero((at >= 0) & alive & alive_2[np.maximum(at, 0)])
                y = at[x]
                mine, theirs = of[x], of_2[y]
                a = (owner[0][mine], owner[1][mine], owner[2][mine] + place[x])
                b = (owner[0][theirs], owner[1][theirs], owner[2][theirs] + place_2[y])
                earlier = (a[0] < b[0]) | (a[0] == b[0]) & ((a[1] < b[1]) | (a[1] == b[1]) & (a[2] < b[2]))
                alive[x[~earlier]] = False
                alive_2[y[earlier]] = False
                marked += [(of[x[~earlier]], place[x[~earlier]]), (of_2[y[earlier]], place_2[y[earlier]])]
            merged.append((strings, of, place, alive))
        low = high
    return (np.concatenate([m[0] for m in marked]), np.concatenate([m[1] for m in marked])) if marked else (np.empty(0, np.int64),) * 2


def _search(others: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Place of each string in a sorted array, or -1."""
    low, high = np.zeros(len(strings), np.int64), np.full(len(strings), len(others))
    a = others.view(np.uint8).reshape(len(others), -1)
    b = strings.view(np.uint8).reshape(len(strings), -1)
    while (low < high).any():
        go = low < high
        mid = (low + high) // 2
        x, y = a[np.minimum(mid, len(a) - 1)], b
        differ = x != y
        first = differ.argmax(1)
        rows = np.arange(len(b))
        less = differ.any(1) & (x[rows, first] < y[rows, first])
        low = np.where(go & less, mid + 1, low)
        high = np.where(go & ~less, mid, high)
    at = np.minimum(low, len(a) - 1)
    return np.where((low < len(a)) & (a[at] == b).all(1), at, -1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes], list[int]]]:
    """Ids, text keys, texts and where in the text they start, some CHUNK bytes at a time; a longer text comes in pieces
    that overlap so that each string is in one of them."""
    ids, keys, texts, starts, size = [], [], [], [], 0
    for batch in batches:
        for d, k, t in zip(*(batch.column(i) for i in range(3)), strict=True):
            b = (t.as_py() or "").encode()
            for low in range(0, len(b) - LENGTH + 1, CHUNK):
                piece = b[low : low + CHUNK + LENGTH - 1]
                if size and size + len(piece) > CHUNK:
                    yield ids, keys, texts, starts
                    ids, keys, texts, starts, size = [], [], [], [], 0
                ids.append(d.as_py())
                keys.append(k.as_py())
                texts.append(piece)
                starts.append(low)
                size += len(piece)
    if texts:
        yield ids, keys, texts, starts


MARKED = "h long, doc_id long, tx long, first int, last int, context binary"
MARK = "doc_id long, tx long, first int, last int"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "doc_id", "tx", "first", "last", "context"])


def _contexts(ids, keys, texts, starts, hit, found) -> list[tuple]:
    """Rows of a chunk: contexts of repeated anchors, the first of equal ones; the others are marks, without a context."""
    h, of, first, last = (x[hit].tolist() for x in found)
    seen: dict[tuple[int, bytes], int] = {}
    rows: list[tuple] = []
    for x, n, a, b in zip(h, of, first, last, strict=True):
        low = starts[n]
        row = (x, ids[n], keys[n], low + a, low + b, texts[n][a : b + LENGTH])
        at = seen.setdefault((x, row[5]), len(rows))
        if at < len(rows):
            other = rows[at]
            if row[1:4] < other[1:4]:
                rows[at], row = row, other
            row = (0, *row[1:5], None)
        rows.append(row)
    return rows


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted by h: frames of whole groups, and where each begins. Groups go on over batches."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        frame = batch if rest is None else rest if batch is None else pd.concat([rest, batch], ignore_index=True)
        if frame is None or not len(frame):
            continue
        h = frame["h"].to_numpy()
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        if batch is not None:
            rest, frame, starts = frame.iloc[starts[-1] :].reset_index(drop=True), frame.iloc[: starts[-1]], starts[:-1]
        if len(frame):
            yield frame, starts


def _firsts(context: list, order: list[tuple], low: int, high: int, marks: list[int]) -> dict[bytes, int]:
    """The first row of each context; the others are added to ``marks``."""
    kept: dict[bytes, int] = {}
    for k in range(low, high):
        other = kept.setdefault(context[k], k)
        if other != k:
            if order[k] < order[other]:
                kept[context[k]], other = k, other
            else:
                other = k
            marks.append(other)
    return kept


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by anchor: marks (doc_id, tx, first, last)."""
    for frame, starts in _groups(batches):
        owners = frame[["doc_id", "tx", "first"]].to_numpy(np.int64).T
        order, context, last = list(zip(*owners.tolist(), strict=True)), frame["context"].tolist(), frame["last"].to_numpy(np.int64)
        equal: list[int] = []
        some: list[int] = []
        size, arrays = 0, []
        for s, t in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
            if t - s < 2:
                continue
            kept = _firsts(context, order, s, t, equal)
            if len(kept) > 1:
                some += kept.values()
                size += sum(map(len, kept))
                if size > SHARD // 2:  # whole anchors share an array: strings of different anchors are never equal
                    arrays.append(some)
                    some, size = [], 0
        out = [(owners[0][equal], owners[1][equal], owners[2][equal], last[equal])]
        for rows in [*arrays, some] if some else arrays:
            mine = owners[:, rows]
            of, place = later([context[k] for k in rows], mine)
            begin = mine[2][of] + place
            out.append((mine[0][of], mine[1][of], begin, begin))
        if any(len(o[0]) for o in out):
            yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("doc_id", "tx", "first", "last"))})


def _thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by h, which stands for anchor, context and salt: the first row of each context; the others lose theirs."""
    for frame, starts in _groups(batches):
        order, context = list(zip(*frame[["doc_id", "tx", "first"]].to_numpy(np.int64).T.tolist(), strict=True)), frame["context"].tolist()
        marks: list[int] = []
        for s, t in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
            _firsts(context, order, s, t, marks)
        for k in marks:
            context[k] = None
        yield frame.assign(h=frame["anchor"], context=context).drop(columns="anchor")


def _finer(gram: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Contexts cut by the anchors of ``gram`` bytes that their strings have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = CHUNK // (2 * LENGTH)  # a context has below 2 * LENGTH bytes
        for batch in batches:
            for low in range(0, len(batch), step):
                rows = batch.iloc[low : low + step]
                contexts = rows["context"].tolist()
                h, of, first, last = anchors(contexts, gram=gram)
                begin = rows["first"].to_numpy()[of]
                cut = [contexts[c][a : b + LENGTH] for c, a, b in zip(of.tolist(), first.tolist(), last.tolist(), strict=True)]
                yield pd.DataFrame({"h": h, "doc_id": rows["doc_id"].to_numpy()[of], "tx": rows["tx"].to_numpy()[of], "first": begin + first, "last": begin + last, "context": cut})

    return run


def _split(rows: DataFrame, counts: DataFrame, gram: int) -> tuple[DataFrame, DataFrame]:
    """Rows of hot anchors (``counts``: h, times) by anchors of ``gram`` bytes, and marks of those whose context comes
    earlier."""
    hot = join_small(rows, counts.withColumnRenamed("h", "__h"), F.col("h") == F.col("__h"), "inner", counts.count())
    salt = F.pmod(F.xxhash64("doc_id", "tx", "first"), F.ceil(F.col("times") / HOT))
    salted = hot.withColumns({"anchor": F.col("h"), "h": F.xxhash64("h", "context", salt)}).drop("__h", "times")
    thin = stored(salted.repartition("h").sortWithinPartitions("h").mapInPandas(_thinned, MARKED), "hot")
    made = stored(thin.filter("context is not null").mapInPandas(_finer(gram), MARKED), "parts")
    return made, thin.filter("context is null").select("doc_id", "tx", "first", "last")


def _base(docs: DataFrame) -> DataFrame:
    """(id, doc_id, tx, text, copied, twin): the order's doc_id, a hash of the text, whether an earlier document has the
    very text, and if not, whether other rows of the same doc_id have."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tx"), F.coalesce("text", F.lit("")).alias("text"))
    sums = rows.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("md"))
    each = sums.groupBy("md", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy("md").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("times")).filter("times > 1")
    again = stored(found.select("md", F.col("first.doc_id").alias("owner"), (F.col("first.n") > 1).alias("twins")), "copies")
    keyed = rows.withColumn("m", F.unhex(F.md5(F.col("text").cast("binary"))))
    joined = join_small(keyed, again, F.col("m") == F.col("md"), "left", again.count(), SMALL)
    copied = F.col("doc_id") > F.col("owner")
    twin = F.lit(False) if again.filter("twins").isEmpty() else F.col("twins") & (F.col("doc_id") == F.col("owner"))
    return joined.select("id", "doc_id", "tx", "text", F.coalesce(copied, F.lit(False)).alias("copied"), F.coalesce(twin, F.lit(False)).alias("twin"))


def _bitmap(anchors_: DataFrame) -> np.ndarray:
    """Bits of hashes, packed by tasks, a piece each, so that the driver gets few rows of BITS / 8 bytes in all."""
    piece = min(BITS, 1 << 17)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        set_ = np.zeros(piece, np.uint8)
        set_[frame["bit"].to_numpy() % piece] = 1
        return pd.DataFrame({"piece": [key[0]], "bits": [np.packbits(set_, bitorder="little").tobytes()]})

    bit = F.col("h").bitwiseAND(BITS - 1)
    rows = anchors_.select(bit.alias("bit"), F.floor(bit / piece).cast("int").alias("piece")).groupBy("piece").applyInPandas(pack, "piece int, bits binary")
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows.toLocalIterator():  # BITS / piece rows at most
        out[r["piece"] * piece // 8 : (r["piece"] + 1) * piece // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def repeats(docs: DataFrame, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents with ``copied``, and marks (doc_id, tx, first, last): strings that start in first..last repeat."""
    base = _base(docs) if base is None else base
    spark = docs.sparkSession
    texts = base.filter(~F.col("copied") & ~F.col("twin")).select("doc_id", "tx", "text")
    twins = base.filter("twin").select("doc_id", "tx", "text")
    if not twins.isEmpty():  # one row of each; the others get its marks by (doc_id, tx)
        texts = texts.union(stored(twins.dropDuplicates(["doc_id", "tx"]), "twins"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk, _ in _chunks(batches):
            h, n = np.unique(anchors(chunk)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    again = stored(texts.mapInArrow(count, "h long, n byte").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "anchors")
    if again.count() <= BITS // 16:
        bits = _bitmap(again)
        held = spark.sparkContext.broadcast(bits)

        def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, keys, chunk, starts in _chunks(batches):
                found = anchors(chunk)
                at = found[0] & (BITS - 1)
                yield _emit(_contexts(ids, keys, chunk, starts, held.value[at >> 3] >> (at & 7) & 1 == 1, found))

        rows = texts.mapInArrow(contexts, MARKED)
    else:

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, keys, chunk, starts in _chunks(batches):
                found = (x.tolist() for x in anchors(chunk))
                yield _emit([(x, ids[n], keys[n], starts[n] + a, starts[n] + b, None) for x, n, a, b in zip(*found, strict=True)])

        hits = texts.mapInArrow(places, MARKED).join(again, "h", "left_semi").groupBy("doc_id", "tx").agg(F.collect_list(F.struct("h", "first", "last")).alias("hits"))

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for d, k, t, found in zip(batch["doc_id"], batch["tx"], batch["text"], batch["hits"], strict=True):
                    data = t.encode()
                    out += [(x["h"], d, k, x["first"], x["last"], data[x["first"] : x["last"] + LENGTH]) for x in found]
                yield pd.DataFrame(out, columns=["h", "doc_id", "tx", "first", "last", "context"])

        rows = texts.join(hits, ["doc_id", "tx"]).select("doc_id", "tx", "text", "hits").mapInPandas(cut, MARKED)
    rows = stored(rows, "contexts")
    marks, some = rows.filter("context is null").select("doc_id", "tx", "first", "last"), rows.filter("context is not null")
    whole = []
    for gram in FINER:
        hot = stored(some.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") > HOT), "hot")
        if hot.isEmpty():
            break
        parts, thinned = _split(some, hot, gram)
        whole.append(join_small(some, hot.select(F.col("h").alias("__h")), F.col("h") == F.col("__h"), "left_anti", hot.count()))
        some, marks = parts, marks.union(thinned)
    some = functools.reduce(DataFrame.union, whole, some)
    return base, marks.union(some.repartition("h").sortWithinPartitions("h").mapInPandas(_shards, MARK))


def removed(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text (what is left, as bytes)."""
    base, marks = repeats(docs)
    spans = stored(marks.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("first", "last")).alias("spans")).withColumnsRenamed({"doc_id": "d", "tx": "k"}), "spans")
    joined = join_small(base, spans, (F.col("doc_id") == F.col("d")) & (F.col("tx") == F.col("k")), "left", spans.agg(F.sum(F.size("spans"))).first()[0] or 0, SMALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, copied, marked in zip(*(batch.column(i) for i in range(4)), strict=True):
                data, runs = t.as_py().encode(), []
                if copied.as_py():
                    runs = [[0, len(data)]] if len(data) >= LENGTH else []
                else:
                    for a, b in sorted((x["first"], x["last"] + LENGTH) for x in marked.as_py() or ()):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], b)
                        else:
                            runs.append([a, b])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                rows.append((d.as_py(), len(data), len(data) - len(kept), len(runs), kept if with_text else None, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"])

    out = joined.select("id", "text", "copied", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary, kept_sha256 string")
    return out if with_text else out.drop("kept_text")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op10_suffix": op10_suffix}
ORACLE: dict[str, str] = {}
