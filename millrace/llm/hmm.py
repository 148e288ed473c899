"""A hidden Markov model of words, and the exact likelihood of texts by it.

Tokens are the words of a text in lower case and one end. Every training word has emissions of its own. Those of the
HEAD words that come most often are held in memory; those of all others are a table, joined to the texts by word.
States are trained by Baum-Welch: every partition adds up the expected counts of its texts, the counts are aggregated by
word, and new probabilities are made of them. First each text has one state, drawn by a hash of its text; rounds over
growing fixed shares of the training rows follow, the last ones over all of them. In the rounds the words of the table
share their emissions by their counts; the last round gathers the expected counts of each of them too. A word's shares of
the states are kept in a byte each (of their roots), and the emissions are made of these, so that they sum to 1 all the same.
Emissions are smoothed towards the base distribution, so every word, known or not, has a probability and those of all
words and one unknown sum to 1.

Texts are scored by the scaled forward recursion, exactly, whatever their length.

Nulls: a null text is empty and has the end only; a null doc_id counts as the empty text for the split (held out).
Repeated rows count each. Without training rows every word is unknown. Empty tables give empty results. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import dropped, recorded, stored, table

#: At most 8, a byte each of a whole number of 64 bits.
STATES = 8
#: Words whose emissions are held in memory; with the two other symbols they fit 16 bits.
HEAD = 65_534
#: Rounds of Baum-Welch: over one of so many training rows, how often.
ROUNDS = ((16, 6), (4, 3), (1, 2))
#: Tasks of a round, at least, if the table has as many.
FEWEST = 12
#: Weight of the base distribution in each state's emissions, in tokens.
SMOOTH = 100.0
TOKENS = 300_000
#: Tokens of rows whose words outside the head are held at once; their long texts go side by side.
HELD = 8 * TOKENS
#: Bytes of text that are parted into words at once.
BYTES = 16_000_000
ADDED = 0.1


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbol x state

    @staticmethod
    def of(start: np.ndarray, step: np.ndarray, emit: np.ndarray, base: np.ndarray) -> Model:
        """From expected counts; base: probability of each symbol."""
        step = step + 0.1 + np.eye(len(step))
        emit = (emit + SMOOTH * base[:, None]) / (emit.sum(0) + SMOOTH)
        return Model((start + 0.1) / (start + 0.1).sum(), step / step.sum(1, keepdims=True), emit)


def packed(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side, longest first, some TOKENS at a time: which, their symbols ordered by time, and per step the
    start in these and the number of texts that are that long."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    low = 0
    while low < len(order):
        high, size = low, 0
        while high < len(order) and (high == low or size + len(texts[order[high]]) <= TOKENS):
            size += len(texts[order[high]])
            high += 1
        which = order[low:high]
        lengths = np.array([len(texts[i]) for i in which])
        active = len(which) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
        begin = np.r_[0, np.cumsum(active)[:-1]]
        flat = np.empty(size, np.int64)
        for k, i in enumerate(which):
            flat[begin[: lengths[k]] + k] = texts[i]
        yield which, flat, begin, active
        low = high


def forward(model: Model, flat: np.ndarray, begin: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities, their scales, and the emissions."""
    emit = model.emit[flat]
    alpha, scale = np.empty_like(emit), np.empty(len(flat))
    before = None
    for b, n in zip(begin.tolist(), active.tolist(), strict=True):
        now = model.start * emit[b : b + n] if before is None else (before[:n] @ model.step) * emit[b : b + n]
        total = now.sum(1)
        now /= total[:, None]
        alpha[b : b + n], scale[b : b + n] = now, total
        before = now
    return alpha, scale, emit


def expected(model: Model, texts: list[np.ndarray], symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of texts: of first states, of steps, of emissions (symbol x state)."""
    k = len(model.start)
    start, step, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    for _, flat, begin, active in packed(texts):
        alpha, scale, emit = forward(model, flat, begin, active)
        after = None
        for t in range(len(begin) - 1, -1, -1):
            b, n = begin[t], active[t]
            if after is None:
                beta = np.ones((n, k))
            else:
                m = len(after)
                beta = np.ones((n, k))
                beta[:m] = after @ model.step.T
                step += alpha[b : b + m].T @ after
            gamma = alpha[b : b + n]
            after = emit[b : b + n] * beta / scale[b : b + n, None]
            gamma *= beta  # alpha of this step isn't needed again
        start += alpha[: active[0]].sum(0)
        for s in range(k):
            emitted[:, s] += np.bincount(flat, alpha[:, s], symbols)
    return start, step * model.step, emitted


def log_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each text's probability."""
    out = np.zeros(len(texts))
    for which, flat, begin, active in packed(texts):
        scale = np.log10(forward(model, flat, begin, active)[1])
        for b, n in zip(begin.tolist(), active.tolist(), strict=True):
            out[which[:n]] += scale[b : b + n]
    return out


def words_of(texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of rows with BYTES of text at most, or one row: the words of each run in order, and how many each row has."""
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    low = size = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (i > low and size + sizes[i] > BYTES):
            if i > low:
                found = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(low, i - low)))
                words = found.flatten()
                real = pc.not_equal(words, "")
                rows = np.repeat(np.arange(i - low), found.value_lengths().to_numpy(zero_copy_only=False))
                yield words.filter(real), np.bincount(rows[real.to_numpy(zero_copy_only=False)], minlength=i - low)
            low, size = i, 0
        if i < len(texts):
            size += sizes[i]


def coded(texts: pa.Array, head: pa.Array) -> Iterator[tuple[list[bytes], pa.ListArray]]:
    """By run of rows, each row's symbols (of words and an end) and its words outside the head."""
    other = len(head)
    for words, lengths in words_of(texts):
        symbols = pc.fill_null(pc.index_in(words, head), other).to_numpy(zero_copy_only=False).astype(np.uint16)
        out = symbols == other
        ends = np.cumsum(lengths)
        rest = np.r_[0, np.cumsum(out)][np.r_[0, ends]]
        lists = pa.ListArray.from_arrays(pa.array(rest, pa.int32()), words.filter(pa.array(out)))
        last = np.uint16(other + 1).tobytes()
        yield [symbols[b:e].tobytes() + last for b, e in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], lists


def _split(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", F.col("text").alias("t"), (F.crc32(key.cast("binary")) % 10 == 0).alias("held_out"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all texts ``t``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _ in words_of(batch.column(0)):
                found = words.value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    return rows.select("t").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def assigned(texts: list[np.ndarray], symbols: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts before the first round: each text has one state, by a hash of its symbols."""
    emitted = np.zeros((symbols, states))
    of = [zlib.crc32(t.tobytes()) % states for t in texts]
    for s in set(of):
        emitted[:, s] = np.bincount(np.concatenate([t for t, k in zip(texts, of, strict=True) if k == s]), minlength=symbols)
    return np.ones(states), np.eye(states) * 100, emitted


def grouped(batch: pa.RecordBatch, symbols: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows with HELD tokens at most, or one row, and their symbols (column number ``symbols``)."""
    texts = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(symbols)]
    low = size = 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > HELD:
            yield batch.slice(low, i - low), texts[low:i]
            low, size = i, 0
        size += len(t)
    if texts:
        yield batch.slice(low), texts[low:]


def with_own(texts: list[np.ndarray], other: int, own: np.ndarray) -> list[np.ndarray]:
    """The texts with the symbols ``own`` in place of ``other``, in the order of the texts."""
    flat = np.concatenate(texts).astype(np.int64)
    flat[flat == other] = own
    return np.split(flat, np.cumsum([len(t) for t in texts])[:-1])


def weights(packed: Column, states: int) -> list[Column]:
    """What ``packed_shares`` keeps of each state: squares of bytes, as small shares matter to a likelihood too."""
    each = [F.shiftrightunsigned(packed, 8 * s).bitwiseAND(F.lit(255).cast("long")) for s in range(states)]
    return [x * x for x in each]


def shared(n: Column, packed: Column, states: int) -> list[Column]:
    """``n`` dealt out by the shares."""
    each = weights(packed, states)
    return [n * x / sum(each[1:], each[0]) for x in each]


def packed_shares(shares: np.ndarray) -> np.ndarray:
    """Shares of the states (words x states, each row sums to 1) in a byte each, of their roots."""
    out = np.zeros((len(shares), 8), np.uint8)
    out[:, : shares.shape[1]] = np.rint(255 * np.sqrt(shares))
    return out.view("<i8").ravel()


def counted(encoded: DataFrame, model: Model | None, n: int, states: int, tails: bool) -> DataFrame:
    """Expected counts by partition. A row per symbol: at, s0, s1, ...; the first states have ``at`` -1, steps from state
    i -2-i. With ``tails`` also a row per word outside the head and run of rows: word, k (occurrences), q (its shares)."""
    held = encoded.sparkSession.sparkContext.broadcast(model)
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        made = lambda at, word, k, q, sums: pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), word.cast(pa.string()), pa.array(k, pa.int64()), pa.array(q, pa.int64()), *[pa.array(sums[:, i], pa.float32()) for i in range(states)]], ["at", "word", "k", "q", *names])
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((n, states))]
        for batch in batches:
            for rows, texts in grouped(batch, 0) if tails else [(batch, [np.frombuffer(x.as_py(), np.uint16) for x in batch.column(0)])]:
                if model is None:
                    part = assigned(texts, n, states)
                elif not tails:
                    part = expected(model, texts, n)
                else:
                    found = rows.column(1).flatten().dictionary_encode()
                    own = found.indices.to_numpy().astype(np.int64)
                    words = found.dictionary
                    wide = Model(model.start, model.step, np.r_[model.emit, np.repeat(model.emit[n - 2 : n - 1], len(words), 0)])
                    part = expected(wide, with_own(texts, n - 2, n + own), n + len(words))
                    each = part[2][n:]
                    part[2][n - 2] += each.sum(0)
                    part = (*part[:2], part[2][:n])
                    if len(words):
                        yield made(np.full(len(words), -100), words, np.bincount(own, minlength=len(words)), packed_shares(each / each.sum(1, keepdims=True)), np.zeros((len(words), states)))
                for a, b in zip(sums, part, strict=True):
                    a += b
        seen = np.flatnonzero(sums[2].any(1))
        at = np.r_[seen, -1, np.arange(-2, -2 - states, -1)]
        zero = np.zeros(len(at), np.int64)
        yield made(at, pa.nulls(len(at), pa.string()), zero, zero, np.r_[sums[2][seen], sums[0][None], sums[1]])

    columns = ["symbols", "rest"] if tails else ["symbols"]
    return encoded.select(*columns).mapInArrow(run, "at int, word string, k long, q long, " + ", ".join(f"{x} float" for x in names))


def gathered(parts: DataFrame, n: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of all partitions: of first states, of steps, of emissions. A row per symbol comes to the driver."""
    names = [f"s{i}" for i in range(states)]
    found = parts.select("at", *names).repartition("at").groupBy("at").agg(*[F.sum(x).alias(x) for x in names]).toPandas()
    at, values = found["at"].to_numpy(), found[names].to_numpy(float)
    emitted, rest = np.zeros((n, states)), np.zeros((1 + states, states))
    emitted[at[at >= 0]] = values[at >= 0]
    rest[-1 - at[at < 0]] = values[at < 0]
    return rest[0], rest[1:], emitted


def tail_table(parts: DataFrame, states: int) -> DataFrame:
    """(word, n, q): the words outside the head, their counts and shares."""
    rows = parts.filter(F.col("word").isNotNull()).select("word", "k", "q").repartition("word")
    sums = rows.groupBy("word").agg(F.sum("k").alias("n"), *[F.sum(x).alias(f"w{s}") for s, x in enumerate(shared(F.col("k"), F.col("q"), states))])
    each = lambda s: F.shiftleft(F.rint(255 * F.sqrt(F.col(f"w{s}") / F.col("n"))).cast("long"), 8 * s)
    return sums.select("word", "n", sum((each(s) for s in range(1, states)), each(0)).alias("q"))


def scored(docs: DataFrame, states: int = STATES, rounds: Sequence[tuple[int, int]] = ROUNDS, head_words: int = HEAD) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = _split(docs)
    train = rows.filter(~F.col("held_out"))
    with recorded() as words_made:
        counts = stored(word_counts(train), "words")
    ends = train.count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, distinct = total + ends, distinct + (ends > 0)
    scale = total + ADDED * (distinct + 1)
    top = counts.orderBy(F.desc("n"), "word").limit(head_words).collect()  # at most head_words
    own = np.array([*[r["n"] for r in top], 0, ends], float)
    base = (own + ADDED) / scale
    others = distinct - len(top) - (ends > 0)
    base[-2] = (total - own.sum() + ADDED * (others + 1)) / scale
    n = len(base)

    held_head = spark.sparkContext.broadcast([r["word"] for r in top])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held_head.value, pa.string())
        for batch in batches:
            low = 0
            for symbols, rest in coded(batch.column(2), known):
                run = batch.slice(low, len(symbols))
                low += len(symbols)
                yield pa.RecordBatch.from_arrays([run.column(0), run.column(1), pa.array(symbols, pa.binary()), rest], ["doc_id", "held_out", "symbols", "rest"])

    encoded = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "t").mapInArrow(encode, "doc_id long, held_out boolean, symbols binary, rest array<string>")
    encoded = stored(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded", "zstd")

    tasks = encoded.rdd.getNumPartitions()

    def share(of: int) -> DataFrame:
        """One of so many training rows, in as many fewer tasks: each hands on a row per symbol."""
        learn = encoded.filter(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(of)) == 0))
        return learn.coalesce(max(tasks // of, FEWEST)) if of > 1 else learn

    model = Model.of(*gathered(counted(share(rounds[0][0]), None, n, states, False), n, states), base)
    steps = [of for of, times in rounds for _ in range(times)]
    for of in steps[:-1]:
        model = Model.of(*gathered(counted(share(of), model, n, states, False), n, states), base)
    with recorded() as made:
        parts = stored(counted(share(steps[-1]), model, n, states, True), "expected", "zstd")
    start, step, emitted = gathered(parts.filter(F.col("word").isNull()), n, states)
    tail = stored(tail_table(parts, states), "tail", "zstd")
    for path in [*words_made, *made]:  # read for the last time
        dropped(spark, path)
    emitted[n - 2] = tail.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in shared(F.col("n"), F.col("q"), states)]).first()
    held = spark.sparkContext.broadcast((Model.of(start, step, emitted, base), np.log10(base), emitted.sum(0)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs, sums = held.value
        for batch in batches:
            for rows, texts in grouped(batch, 2):
                others = np.array([(t == n - 2).sum() for t in texts], np.int64)
                found = rows.column(3)
                flat = found.flatten()
                at = np.repeat(np.cumsum(others) - others, others) + flat.field("i").to_numpy()
                times, q = np.zeros(len(at)), np.zeros(len(at), "<i8")
                times[at], q[at] = flat.field("n").to_numpy(), flat.field("q").to_numpy()
                shares = q.view(np.uint8).reshape(-1, 8)[:, :states].astype(float) ** 2
                shares /= np.maximum(shares.sum(1, keepdims=True), 1)
                plain = (times + ADDED) / scale
                tails = (times[:, None] * shares + SMOOTH * plain[:, None]) / (sums + SMOOTH)
                wide = Model(model.start, model.step, np.r_[model.emit, tails])
                value = log_likelihood(wide, with_own(texts, n - 2, n + np.arange(len(at))))
                owner = np.repeat(np.arange(len(texts)), others)
                base_score = np.array([logs[t[t != n - 2]].sum() for t in texts]) + np.bincount(owner, np.log10(plain), len(texts))
                lengths = np.array([len(t) for t in texts], np.int64)
                known = lengths - others - (0 if ends else 1) + np.bincount(owner, times > 0, len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lengths), pa.array(known), pa.array(np.full(len(texts), total, np.int64)), pa.array(base_score, pa.float64()), pa.array(value, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    places = encoded.select("row", F.posexplode("rest").alias("i", "word")).join(tail, "word", "left")
    places = places.select("row", F.struct("i", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", F.lit(0)).alias("q")).alias("f")).repartition("row")
    found = places.groupBy("row").agg(F.collect_list("f").alias("found"))  # as many as a text has words
    out = encoded.select("row", "doc_id", "held_out", "symbols").join(found, "row", "left").select("doc_id", "held_out", "symbols", "found")
    return out.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op3_hmm": op3_hmm}
ORACLE: dict[str, str] = {}
