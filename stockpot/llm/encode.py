"""Encoding with a public byte-level BPE, in which chunks that documents share are encoded once.

Texts are cut into chunks where a rolling hash of the last characters says so, so that the same passage is cut alike
wherever it stands. Chunks found in several documents are encoded once, as a table, and joined back. A cut that falls
inside a unit of the tokenizer's pattern would change the tokens there: such a join is repaired by encoding it anew, with
what is before and after the cut up to the next places where the pattern always ends a unit. Since those places split a
text into parts that are encoded independently, the ids are exactly those of the whole text.

Where only numbers of tokens are wanted, pieces that end at such places are counted, and each Python worker keeps those
it has met lately, of at most ``KEEP_PIECE`` characters and within a bound of memory.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import skew_left_join, spread, written

#: Place of the vocabulary on every machine; a parameter of all operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern published with this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Of chunks: one cut in so many characters, the characters that decide it, and the least length of a core.
CHUNK_EVERY, CHUNK_WINDOW, CHUNK_LEAST = 64, 16, 24
#: The same for the pieces whose tokens are only counted.
CUT_EVERY, WINDOW = 2, 4
#: Characters of pieces that a worker keeps in each of its two generations, and the longest piece kept.
KEEP_CHARS, KEEP_PIECE = 40_000_000, 400

LETTER, NUMBER, SPACE, OTHER, QUOTE, UNKNOWN, UNSEEN = range(7)


_table = np.full(0x110000, UNSEEN, np.uint8)
_table[list(WHITE_SPACE)] = SPACE
_table[ord("'")] = QUOTE


def char_classes(cp: np.ndarray) -> np.ndarray:
    """Class of each character as the pattern sees it; unassigned ones are never cut at. Looked up once for each."""
    got = _table[cp]
    unseen = got == UNSEEN
    if unseen.any():
        for c in np.unique(cp[unseen]).tolist():
            kind = unicodedata.category(chr(c))
            _table[c] = UNKNOWN if kind == "Cn" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)
        got = _table[cp]
    return got


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def safe_places(cls: np.ndarray) -> np.ndarray:
    """For each i whether a cut between characters i and i + 1 keeps all units of the pattern.

    So it is after punctuation before a letter, a number or white space, unless the mark is a quote, which may begin a
    contraction. (Other places would do as well, but give many short pieces.)
    """
    a, b = cls[:-1], cls[1:]
    return (a == OTHER) & ((b == SPACE) | (b == LETTER) | (b == NUMBER))


def rolling_cuts(cp: np.ndarray, every: int = CUT_EVERY, window: int = WINDOW) -> np.ndarray:
    """For each i whether the rolling hash of the characters up to i asks for a cut after it."""
    h = np.zeros(len(cp), np.uint32)
    for j in range(window):
        h[j:] += cp[: max(0, len(cp) - j)] * np.uint32((0x9E3779B1 * (2 * j + 1)) & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h % np.uint32(every) == 0


def piece_bounds(cp: np.ndarray, ends: np.ndarray, every: int = CUT_EVERY) -> np.ndarray:
    """Where the pieces of a batch of texts end, all texts standing one after another and ending at ``ends``."""
    mark = np.zeros(len(cp) + 1, bool)
    if len(cp) > 1:
        mark[1:-1] = safe_places(char_classes(cp))
    mark[ends] = True
    mark[0] = True
    safe = np.flatnonzero(mark)
    cuts = np.flatnonzero(rolling_cuts(cp, every)) + 1
    right = np.minimum(np.searchsorted(safe, cuts, "left"), len(safe) - 1)
    mark[:] = False
    mark[safe[right]] = mark[ends] = True
    mark[0] = False
    return np.flatnonzero(mark)


class Encoder:
    """A vocabulary with the ids of the pieces met lately; one for each worker process."""

    def __init__(self, path: str, keep_chars: int = KEEP_CHARS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = _Known(self.bpe)
        self.keep_chars = keep_chars

    def ids(self, piece: str) -> list[int]:
        return self.bpe.encode_ordinary(piece)

    def packed(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as 32-bit numbers; what was encoded before is looked up."""
        gc.disable()  # nothing made here can form a cycle
        try:
            got = list(map(self.known.__getitem__, pieces))
        finally:
            gc.enable()
        self.known.trim(self.keep_chars)
        return got


def _numbers(bpe, text: str) -> np.ndarray:
    """The ids of a text as an array."""
    return bpe.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)


class _Known(dict):
    """Pieces and their ids in two generations: when the new one is full it becomes the old one."""

    def __init__(self, bpe):
        self.bpe, self.old, self.chars = bpe, {}, 0

    def __missing__(self, piece: str) -> bytes:
        got = self.old.get(piece)
        if got is None:
            got = array("i", self.bpe.encode_ordinary(piece)).tobytes()
        if len(piece) <= KEEP_PIECE:
            self[piece] = got
            self.chars += len(piece) + 60
        return got

    def trim(self, keep_chars: int) -> None:
        if self.chars > keep_chars:
            self.old, self.chars = dict(self), 0
            self.clear()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_batch(texts: list[str | None], enc: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, offsets of the texts in them)."""
    whole = [t or "" for t in texts]
    text, ends = "".join(whole), np.cumsum([len(t) for t in whole], dtype=np.int64)
    bounds = piece_bounds(code_points(text), ends)
    cut = bounds.tolist()
    parts = enc.packed([text[a:b] for a, b in zip([0, *cut[:-1]], cut)])
    sizes = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 4
    ids = np.frombuffer(b"".join(parts), np.int32)
    last = np.searchsorted(bounds, ends, "right")
    offsets = np.concatenate([[0], np.where(last > 0, sizes[np.maximum(last - 1, 0)] if len(sizes) else 0, 0)])
    return ids, offsets.astype(np.int64)


def batches_of_texts(b: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of a batch in runs of about ``most`` bytes, so that long texts don't add up in memory."""
    col = b.column(column)
    size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy()
    run = np.cumsum(size) // most if len(size) else size
    at = 0
    while at < len(size):
        to = int(np.searchsorted(run, run[at], "right"))
        yield at, col.slice(at, to - at).to_pylist()
        at = to


def chunk_cores(texts: list[str], every: int = CHUNK_EVERY, shortest: int = CHUNK_LEAST) -> Iterator[list[tuple[int, int, bytes]]]:
    """For each text the parts (from, to, digest) of its content-defined chunks that are encoded alike wherever they stand.

    A chunk ends where the rolling hash of the last characters of its own text says so. The hash may ask for a cut within
    a unit of the pattern, so a chunk's core reaches from its first to its last place where the pattern always ends a
    unit; what lies between two cores is the join that is encoded anew. Cores of fewer than ``shortest`` characters are
    not worth a lookup.
    """
    gap = "\0" * CHUNK_WINDOW
    whole = gap + "".join(t + gap for t in texts)
    cp = code_points(whole)
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + CHUNK_WINDOW) - size
    safe = np.zeros(len(cp) + 1, bool)
    safe[1:-1] = safe_places(char_classes(cp))
    safe[start] = safe[start + size] = True
    places = np.flatnonzero(safe)
    cut = np.zeros(len(cp) + 1, bool)
    cut[1:] = rolling_cuts(cp, every, CHUNK_WINDOW)
    for s, n, text in zip(start.tolist(), size.tolist(), texts):
        ends = np.append(np.flatnonzero(cut[s + 1 : s + n]) + s + 1, s + n)
        begins = np.concatenate([[s], ends[:-1]])
        lo, hi = places[np.searchsorted(places, begins, "left")], places[np.searchsorted(places, ends, "right") - 1]
        long = hi - lo >= shortest
        yield [(x, y, hashlib.blake2b(text[x:y].encode("utf-8", "surrogatepass"), digest_size=16).digest()) for x, y in zip((lo[long] - s).tolist(), (hi[long] - s).tolist())]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, t) -> (k, digest): the different chunk cores of each text."""
    for b in batches:
        for at, texts in batches_of_texts(b, "t"):
            own = [list({d for _, _, d in c}) for c in chunk_cores([t or "" for t in texts])]
            row = np.repeat(np.arange(at, at + len(texts)), [len(o) for o in own])
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row)), pa.array([d for o in own for d in o], pa.binary())], ["k", "digest"])


def _ids_column(parts: list[list[np.ndarray]]) -> pa.Array:
    """The ids of each row, given in parts."""
    off = np.concatenate([[0], np.cumsum([sum(map(len, p)) for p in parts])]).astype(np.int32)
    flat = [x for p in parts for x in p]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)))


def shared_chunks(rows: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(marks, encoded): (k, digest) of the chunk cores of ``rows`` (k, t), and (digest, ids) of those in several texts.

    Each chunk that several documents share is encoded once, by the first of them. Documents whose key is null or occurs
    more than once take no part.
    """
    single = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("k")
    marks = written(rows.select("k", "t").mapInArrow(_marks, f"k {dict(rows.dtypes)['k']}, digest binary").join(single, "k", "left_semi"), "chunk-marks")
    shared = marks.groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last")
    wanted = shared.groupBy(F.col("first").alias("k")).agg(F.collect_list("digest").alias("digests"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary).bpe
        for b in batches:
            for at, texts in batches_of_texts(b, "t"):
                digests, ids = [], []
                for text, cores, asked in zip(texts, chunk_cores([t or "" for t in texts]), b.column("digests").slice(at, len(texts)).to_pylist()):
                    open_ = set(asked)
                    for x, y, d in cores:
                        if d in open_:
                            open_.remove(d)
                            digests.append(d)
                            ids.append([_numbers(bpe, text[x:y])])
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), _ids_column(ids)], ["digest", "ids"])

    encoded = rows.join(wanted, "k").select("t", "digests").mapInArrow(make, "digest binary, ids array<int>")
    return marks, written(encoded, "encoded-chunks")


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): one row for each row of ``docs``, ids as array<int> without special tokens.

    Chunks that several documents share are encoded once (see :func:`shared_chunks`) and come to their documents by a
    join; what lies between them is encoded in place, from a place where the pattern ends a unit to the next, so that the
    ids are those of the whole text. Null and empty texts give an empty list; repeated keys give a row each; other
    columns are left behind. Texts are encoded whole, whatever their length.
    """
    kind = dict(docs.dtypes)[key]
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))
    marks, encoded = shared_chunks(rows, vocabulary)
    found = skew_left_join(marks, encoded, "digest").where("ids is not null").groupBy("k").agg(F.collect_list(F.struct("digest", "ids")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary).bpe
        for b in batches:
            for at, texts in batches_of_texts(b, "t"):
                given = b.column("found").slice(at, len(texts))
                some = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False)).tolist()
                cores = dict(zip(some, chunk_cores([texts[i] for i in some]))) if some else {}
                first, each = given.offsets.to_numpy(), given.values
                ids, off = each.field("ids").values.to_numpy(), each.field("ids").offsets.to_numpy()
                out = []
                for i, t in enumerate(texts):
                    parts, p = [], 0
                    own = range(first[i], first[i + 1]) if i in cores else ()
                    known = {each.field("digest")[j].as_py(): ids[off[j] : off[j + 1]] for j in own}
                    for x, y, d in cores.get(i, ()):
                        if d in known:
                            parts += [_numbers(bpe, t[p:x]), known[d]]
                            p = y
                    parts.append(_numbers(bpe, (t or "")[p:]))
                    out.append(parts)
                yield pa.RecordBatch.from_arrays([b.column("k").slice(at, len(texts)), _ids_column(out)], ["k", "ids"])

    return rows.join(found, "k", "left").mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the length of each text in tokens, 0 for null and empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for at, texts in batches_of_texts(b, "t"):
                _, off = encode_batch(texts, enc)
                yield pa.RecordBatch.from_arrays([b.column("k").slice(at, len(texts)), pa.array(np.diff(off))], ["k", "n_tokens"])

    kind = dict(docs.dtypes)[key]
    return spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"k {kind}, n_tokens long").withColumnRenamed("k", key)


def token_bytes(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes): how many bytes the tokens of each row of (key, ids) stand for together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary).bpe
        size = np.array([len(bpe.decode_single_token_bytes(t)) for t in range(bpe.max_token_value + 1)], np.int64)
        for b in batches:
            off = b.column("ids").offsets.to_numpy()
            total = np.concatenate([[0], np.cumsum(size[b.column("ids").values.to_numpy()])])
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(total[off[1:]] - total[off[:-1]])], ["k", "n_bytes"])

    kind = dict(encoded.dtypes)[key]
    return encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, n_bytes long").withColumnRenamed("k", key)
