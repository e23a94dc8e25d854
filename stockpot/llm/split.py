"""Texts above a limit of tokens cut into overlapping pieces where their topic changes.

A text is a row of sentences. How alike the sentences before and after each gap are (the cosine of their counts of
character pairs, over a sliding block of sentences) gives a curve whose valleys mark changes of topic. Each piece takes
as many tokens as fit between half the limit and the limit and ends at the deepest valley there, a valley counting more
at the end of a paragraph. Every further piece begins with the last tokens of the piece before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .encode import NUMBER, LETTER, OTHER, SPACE, VOCABULARY, batches_of_texts, char_classes, code_points, encoder

#: Characters that end a sentence (fixed values).
ENDS = "。！？!?…；;.~"
DIMS, BLOCK = 256, 4
PIECES = "k {kind}, piece int, from_char int, to_char int, body_from int, n_tokens int, text string"


def sentence_bounds(cp: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends of sentences, whether each is also the end of a line), all at places where the pattern ends a unit."""
    n = len(cp)
    ends = np.isin(cp, np.array([ord(c) for c in ENDS], np.uint32))
    line = np.isin(cp, np.array([10, 13], np.uint32))
    after_end = np.zeros(n + 1, bool)
    # after closing marks that follow an end of sentence, before what is no mark; a full stop within a number is none
    mark = ends[:-1] & (cls[:-1] == OTHER) & ((cls[1:] == SPACE) | (cls[1:] == LETTER) | ((cls[1:] == NUMBER) & (cp[:-1] != ord("."))))
    after_end[1:n] |= mark
    # before the first white space of a run that holds a line end: such a run goes to the next sentence
    breaks = (cls[:-1] != SPACE) & line[1:]
    after_end[1:n] |= breaks
    after_end[n] = True
    at = np.flatnonzero(after_end)
    para = np.zeros(n + 1, bool)
    para[1:n] |= breaks
    para[n] = True
    return at, para[at]


def _any_bounds(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Ends of units at lesser marks, for sentences that are themselves too long."""
    inner = (cls[:-1] == OTHER) & ((cls[1:] == LETTER) | (cls[1:] == NUMBER) | (cls[1:] == SPACE)) | ((cls[:-1] != SPACE) & (cls[1:] == SPACE))
    return np.append(np.flatnonzero(inner) + 1, len(cp))


def cohesion_depths(cp: np.ndarray, bounds: np.ndarray, block: int = BLOCK, dims: int = DIMS) -> np.ndarray:
    """For each bound the depth of the valley of likeness there; 0 at the last."""
    k = len(bounds)
    if k < 3:
        return np.zeros(k)
    unit = np.repeat(np.arange(k), np.diff(np.concatenate([[0], bounds])))
    word = (((cp[:-1].astype(np.uint64) * np.uint64(31) + cp[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(dims)
    counts = np.bincount(unit[:-1] * dims + word.astype(np.int64), minlength=k * dims).reshape(k, dims).astype(np.float32)
    total = np.concatenate([np.zeros((1, dims), np.float32), np.cumsum(counts, axis=0)])
    i = np.arange(1, k)
    left = total[i] - total[np.maximum(0, i - block)]
    right = total[np.minimum(k, i + block)] - total[i]
    norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
    like = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-12), 0.0)
    # the nearest peaks on both sides, within a block's reach
    pad = np.pad(like, block, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(pad, 2 * block + 1)
    depth = windows[:, : block + 1].max(1) + windows[:, block:].max(1) - 2 * like
    return np.append(depth, 0.0)


class Cutter:
    """Cuts one text after another; see :func:`split_long`."""

    def __init__(self, path: str, limit: int, overlap: int):
        if not 0 <= overlap < limit // 2:
            raise ValueError("the overlap is less than half the limit")
        self.enc, self.limit, self.overlap = encoder(path), limit, overlap
        self.size = [len(self.enc.bpe.decode_single_token_bytes(t)) for t in range(self.enc.bpe.max_token_value + 1)]

    def _units(self, text: str) -> tuple[list[int], list[int], list[float], bool]:
        """(ends, tokens, worth of a cut there, whether the tokens add up) of parts of at most limit - overlap tokens."""
        cp = code_points(text)
        cls = char_classes(cp)
        bounds, para = sentence_bounds(cp, cls)
        depth = cohesion_depths(cp, bounds)
        worth = depth + np.where(para, 1.0, 0.5)
        ends = bounds.tolist()
        lens = [len(p) // 4 for p in self.enc.packed([text[a:b] for a, b in zip([0, *ends[:-1]], ends)])]
        most = self.limit - self.overlap
        if max(lens) <= most:
            return ends, lens, worth.tolist(), True
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        inner, at, sums = _any_bounds(cp, cls), 0, True
        for b, n, w in zip(ends, lens, worth.tolist()):
            cuts = [b] if n <= most else [*inner[(inner > at) & (inner < b)].tolist(), b]
            for c in cuts:
                m = n if len(cuts) == 1 and n <= most else len(self.enc.packed([text[at:c]])[0]) // 4
                sums = sums and m <= most
                for d in [c - at] if m <= most else self._forced(text[at:c], most):
                    part = text[out[0][-1] if out[0] else 0 : at + d]
                    out[0].append(at + d)
                    out[1].append(m if m <= most else len(self.enc.ids(part)))
                    out[2].append(w if at + d == b else 0.0)
                at = c
        return *out, sums

    def _forced(self, text: str, most: int) -> list[int]:
        """Ends, in characters, of parts of a text without places to cut, each of at most ``most`` tokens."""
        ends, at = [], 0
        while at < len(text):
            # a token is seldom longer than 16 characters; the window grows where it is
            width = 4 * most
            while True:
                window = text[at : at + width]
                ids = self.enc.ids(window)
                if len(ids) > most or at + width >= len(text):
                    break
                width *= 2
            raw, stop = window.encode("utf-8", "surrogatepass"), len(window)
            if len(ids) > most:
                cut = sum(self.size[t] for t in ids[:most])
                while raw[cut] & 0xC0 == 0x80:
                    cut -= 1
                stop = max(1, len(raw[:cut].decode("utf-8", "surrogatepass")))
                while stop > 1 and len(self.enc.ids(text[at : at + stop])) > most:
                    stop -= 1
            at += stop
            ends.append(at)
        return ends

    def _tail(self, text: str, start: int, stop: int) -> tuple[int, int]:
        """(where the last ``overlap`` tokens of text[start:stop] begin, moved on to a character; their number)."""
        if not self.overlap:
            return stop, 0
        width = 2 * self.overlap
        while True:
            window = text[max(start, stop - width) : stop]
            ids = self.enc.ids(window)
            if len(ids) > self.overlap + 8 or stop - width <= start:
                break
            width *= 2
        if len(ids) <= self.overlap:
            return stop - len(window), len(ids)
        raw = window.encode("utf-8", "surrogatepass")
        at = len(raw) - sum(self.size[t] for t in ids[-self.overlap :])
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        tail = raw[at:].decode("utf-8", "surrogatepass")
        while (n := len(self.enc.ids(tail))) > self.overlap:
            tail = tail[1:]
        return stop - len(tail), n

    def pieces(self, text: str) -> list[tuple[int, int, int, int]]:
        """(begin with overlap, end, begin without, tokens) of each piece, in characters; [] if the text is within the limit."""
        ends, lens, worth, sums = self._units(text)
        if len(ends) == 1 or sum(lens) <= self.limit and (sums or len(self.enc.ids(text)) <= self.limit):
            return []
        out, i, body, begin, head = [], 0, 0, 0, 0
        while i < len(ends):
            room, j, used, best, best_at = self.limit - head, i, 0, -1.0, i
            while j < len(ends) and used + lens[j] <= room:
                used += lens[j]
                # from half of the room on the deepest valley counts; of equal ones the last
                if used * 2 >= room and worth[j] >= best:
                    best, best_at = worth[j], j
                j += 1
            if j == len(ends):
                best_at = j - 1
            elif best < 0:
                best_at = max(i, j - 1)
            while True:
                # units end where tokens do, so that their numbers add up; only forced cuts need a count of the whole
                n = head + sum(lens[i : best_at + 1]) if sums else len(self.enc.ids(text[begin : ends[best_at]]))
                if n <= self.limit or best_at == i:
                    break
                best_at -= 1
            while n > self.limit and begin < body:
                begin += 1
                n = len(self.enc.ids(text[begin : ends[best_at]]))
            out.append((begin, ends[best_at], body, n))
            body = ends[best_at]
            begin, head = self._tail(text, out[-1][2], body)
            i = best_at + 1
        return out


def split_long(docs: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece, from_char, to_char, body_from, n_tokens, text) of the texts with more than ``limit`` tokens.

    Pieces are numbered from 0 and have at most ``limit`` tokens, counted on the piece itself. Their bodies, from
    body_from to to_char, follow one another and make up the text; before its body a piece repeats the last
    ``overlap`` tokens of the body before (from_char to body_from; moved on to the start of a character, so at most three
    tokens fewer). Bodies end at paragraphs or sentences, within a sentence that is too long at lesser marks or spaces,
    and inside a word only where there is none of these. Null, empty and short texts give no row; repeated keys are
    cut each.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(vocabulary, limit, overlap)
        names = ["k", "piece", "from_char", "to_char", "body_from", "n_tokens", "text"]
        for b in batches:
            for at, texts in batches_of_texts(b, "t"):
                row, cols = [], []
                for r, t in enumerate(texts):
                    got = cutter.pieces(t)
                    row += [at + r] * len(got)
                    cols += [(p, f, e, s, n, t[f:e]) for p, (f, e, s, n) in enumerate(got)]
                if cols:
                    flat = list(zip(*cols))
                    kinds = [pa.int32()] * 5 + [pa.string()]
                    yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(row)), *(pa.array(c, k) for c, k in zip(flat, kinds))], names)

    # a token has at least one byte: shorter texts can't exceed the limit and needn't be looked at
    long = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.octet_length("t") > limit)
    return spread(long).mapInArrow(run, PIECES.format(kind=kind)).withColumnRenamed("k", key)
