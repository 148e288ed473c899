"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A vocabulary of ranks fixes, for every byte string, one sequence of tokens (what merging the
neighbours of lowest rank, leftmost first, ends with). A sequence is that encoding exactly if each
neighbouring pair of its tokens is: the pair's joined bytes must encode to the pair. So each prefix
of a text has one valid last token, found from the prefixes before it by trying the tokens that are
suffixes of the prefix. ``PrefixTable`` stores that token for every prefix: appending extends the
table, an edit recomputes it from the edit until it agrees with the old one again.

Nulls: a null text is the empty text and has no tokens; a null doc_id stays. Repeated rows give
repeated results. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held, trimmed

#: Unicode white space, which never stands inside a piece but at its start.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
#: What keeps a text from being cut by plain replacement: other white space or two in a row, and stops or commas
#: that follow neither a letter nor a digit.
UNEVEN = re.compile(f"[\0{WHITE[0]}{WHITE[2:5]}{WHITE[6:]}]|[ \n][ \n]|^[ \n.,]|[ \n]\\Z|[^\\w][.,]|_[.,]")
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Entries that a worker keeps at most; then it starts anew.
KEPT = 200_000
#: Rows whose results a worker holds at a time.
ROWS = 1000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    """Ranks, and whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pieces = regex.compile(pattern)
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 3:
                sizes.setdefault(token[-4:], set()).add(len(token))
        #: Lengths of the tokens that end with four given bytes, longest first, and those below four.
        self.sizes = {end: (*sorted(found, reverse=True), 3, 2, 1) for end, found in sizes.items()}
        self.pairs: dict[int, bool] = {}
        self.chunks = _Kept(self.encode_chunk, 64)
        self.prefixes: dict[bytes, int] = {}
        self.lengths = [len(x) for x in self.bytes_of]

    def merged(self, data: bytes) -> list[int]:
        """The definition: merges of lowest rank first. Used for a token or a pair only."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left; left -1: whether right may begin."""
        if len(self.pairs) > 2 * KEPT:
            self.pairs.clear()
        both = [right] if left < 0 else [left, right]
        known = self.pairs[left << 24 | right] = self.merged(b"".join(self.bytes_of[t] for t in both)) == both
        return known

    def extend(self, data: bytes | bytearray, last: list[int], upto: int) -> None:
        """Adds to ``last`` the valid last tokens of the prefixes of data up to length ``upto``; last[i] is that of data[:i]."""
        rank, known, sizes_of, fits = self.ranks.get, self.pairs.get, self.sizes.get, self.fits
        for end in range(len(last), upto + 1):
            for size in sizes_of(data[end - 4 : end], (3, 2, 1)) if end > 3 else (3, 2, 1):
                if size <= end:
                    token = rank(data[end - size : end])
                    if token is not None:
                        left = last[end - size]
                        valid = known(left << 24 | token)
                        if valid or valid is None and fits(left, token):
                            last.append(token)
                            break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def encode_piece(self, piece: str) -> list[int]:
        """By the prefixes that are already known; the last tokens of those that aren't are added."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size, prefixes = len(data), self.prefixes
        if size > 64:
            last = [-1]
            self.extend(data, last, size)
            return walked(last, self.bytes_of)
        seen = size
        while seen and data[:seen] not in prefixes:
            seen -= 1
        if seen < size:
            if len(prefixes) > KEPT:
                prefixes.clear()
                seen = 0
            last = [-1, *[prefixes[data[:i]] for i in range(1, seen + 1)]]
            self.extend(data, last, size)
            for i in range(seen + 1, size + 1):
                prefixes[data[:i]] = last[i]
            return walked(last, self.bytes_of)
        found, lengths = [], self.lengths
        while size:
            token = prefixes[data[:size]]
            found.append(token)
            size -= lengths[token]
        return found[::-1]

    def encode_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha():
            return array("I", self.encode_piece(chunk)).tobytes()
        return array("I", [t for piece in self.pieces.findall(chunk) for t in self.encode_piece(piece)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The token ids of a text as little-endian unsigned 32-bit integers.

        Pieces never cross from a character that isn't white to one that is, nor from a letter or digit
        to a stop or comma, so the text is first cut there; what such a chunk encodes to is kept.
        """
        if not text:
            return b""
        if UNEVEN.search(text):
            cut = CHUNK.findall(text)
        else:
            cut = text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n").split("\0")
        return b"".join(map(self.chunks.__getitem__, cut))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Kept(dict):
    """Results by text, of texts up to a length. Once half of KEPT are new, those that were not met again since the last
    time are let go, so that frequent ones stay."""

    def __init__(self, make, longest: int):
        super().__init__()
        self.make, self.longest, self.before = make, longest, {}

    def __missing__(self, key: str):
        made = self.before.get(key)
        if made is None:
            made = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= KEPT // 2:
                self.before = dict(self)
                self.clear()
            self[key] = made
        return made


def walked(last: list[int], bytes_of: list[bytes]) -> list[int]:
    found, end = [], len(last) - 1
    while end:
        found.append(last[end])
        end -= len(bytes_of[last[end]])
    return found[::-1]


class PrefixTable:
    """A byte string with the last token of each of its prefixes; encodes without the cut into pieces."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.span = max(map(len, vocabulary.ranks))
        self.computed = 0
        self.append(data)

    def _upto(self, end: int) -> None:
        before = len(self.last)
        # Tokens are looked up as bytes: only the part that a token can reach is copied.
        low = max(0, before - 1 - self.span)
        last = self.last[low:]
        self.vocabulary.extend(bytes(self.data[low:end]), last, end - low)
        self.last += last[before - low :]
        self.computed += len(self.last) - before

    def append(self, more: bytes) -> None:
        self.data += more
        self._upto(len(self.data))

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replaces data[start:stop]; recomputes until a token's span of prefixes agrees with what was there before."""
        old, shift, agreed = self.last, len(new) - (stop - start), 0
        self.data[start:stop] = new
        self.last = old[: start + 1]
        while len(self.last) <= len(self.data):
            at = len(self.last)
            self._upto(at)
            agreed = agreed + 1 if at - shift > stop and old[at - shift] == self.last[at] else 0
            if agreed >= self.span and at - self.span >= start + len(new):
                self.last += old[at - shift + 1 :]

    def tokens(self) -> list[int]:
        return walked(self.last, self.vocabulary.bytes_of)


def loaded(data: bytes, pattern: str) -> Vocabulary:
    """One vocabulary per worker process, kept between tasks until another operator's begin."""
    key, kept = hashlib.sha256(data + pattern.encode()).hexdigest(), held("bpe")
    if key not in kept:
        kept.clear()
        kept[key] = Vocabulary(read_ranks(data), pattern)
    return kept[key]


#: What encode_documents can return besides the columns it carries.
OUTPUTS = {"ids": pa.large_binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.large_binary(), "decoded_sha256": pa.string()}
SQL_TYPES = {"ids": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, outputs: Iterable[str] = ("ids", "n_tokens"), text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the carried columns, then ``outputs``. No shuffle; a text is encoded whole.

    ``ranks``: a rank file's bytes, of about a megabyte whatever the input; they are broadcast.
    """
    outputs, spark = tuple(outputs), docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)

    def encoded(vocabulary: Vocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, list] = {k: [] for k in outputs}
        for x in batch.column(batch.num_columns - 1):
            ids = vocabulary.encode(x.as_py() or "")
            for k in outputs:
                if k == "ids":
                    found[k].append(ids)
                elif k == "n_tokens":
                    found[k].append(len(ids) // 4)
                elif k == "ids_sha256":
                    found[k].append(hashlib.sha256(ids).hexdigest())
                else:
                    plain = vocabulary.decode(ids)
                    found[k].append(plain if k == "decoded" else hashlib.sha256(plain).hexdigest())
        kept = [batch.column(i) for i in range(len(carry))]
        made = [pa.array(found[k], {"ids": pa.binary(), "decoded": pa.binary()}.get(k, OUTPUTS[k])) for k in outputs]
        return pa.RecordBatch.from_arrays(kept + made, [f"c{i}" for i in range(len(kept) + len(made))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(shared.value, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):  # so that only some rows' ids are held at a time
                yield encoded(vocabulary, batch.slice(low, ROWS))
                trimmed()

    types = [docs.schema[c].dataType.simpleString() for c in carry] + [SQL_TYPES[k] for k in outputs]
    out = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("text_in")).mapInArrow(run, ", ".join(f"c{i} {t}" for i, t in enumerate(types)))
    return out.toDF(*carry, *outputs)


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``decoded``, the bytes of each row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(shared.value, pattern)
        for batch in batches:
            plain = pa.array([vocabulary.decode(x.as_py() or b"") for x in batch.column(batch.num_columns - 1)], pa.binary())
            kept = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, plain], [f"c{i}" for i in range(len(kept) + 1)])

    types = [encoded.schema[c].dataType.simpleString() for c in carry] + ["binary"]
    out = encoded.select(*carry, ids).mapInArrow(run, ", ".join(f"c{i} {t}" for i, t in enumerate(types)))
    return out.toDF(*carry, "decoded")


#: The production vocabulary, by name, in the folder of public tokenizers.
RANKS_FILE = "byte_bpe_multi_50k.tiktoken"


def production_ranks(name: str = RANKS_FILE) -> tuple[bytes, str]:
    """The rank file's bytes and the pattern of pieces."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = production_ranks()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, ranks, pattern, ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE: dict[str, str] = {}
