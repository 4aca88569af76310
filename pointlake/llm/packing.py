"""Order-preserving packing by dynamic programming.

Documents stay in the order of their partition. Window cuts fall on document or sentence ends, and
every eighth of a window where more than half a window has neither. They are chosen to minimise
padding, a cost for each sequence, and truncation penalties: higher for a cut within a document that
fits a window than within one that has to be cut anyway. The least cost over all windows that may end
at a place is a sliding window minimum, kept in a monotone queue, so the work grows with the number of
places.

A sequence is padded to ``window`` unless its length is a power of two.

Edge cases: a null or empty text is the end id alone; very long documents span as many sequences as
they need; repeated rows are packed each; ids are of an integer type and may be null. Each id lies in
exactly one piece. Other columns, whatever their names, are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered

WINDOW = 2048
#: Cost, in ids of padding, of a sequence; of a cut at a sentence's end within a document that is
#: longer than a window, and within one that is not; and what a cut elsewhere costs besides.
SEQUENCE, LONG, SHORT, ANYWHERE = 64.0, 4.0, 40.0, 64.0
#: Ids that are planned together.
BLOCK = 1 << 20
_SPECIAL = "<|endoftext|>"
_STRETCH = 2000


class Encoder:
    """Token ids as the vocabulary file's tokenizer gives them.

    The ranks of the same file drive a faster encoder for the same byte-level BPE; texts with the
    special token, or with a stretch that its regular expression could be slow on, go to the
    reference tokenizer.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: b for b, c in _byte_chars().items()}
        self.spelt = {k: bytes(byte[c] for c in piece) for piece, k in vocab.items() if all(c in byte for c in piece)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={b: k for k, b in self.spelt.items()}, special_tokens={})
        self.space, self.ink = re.compile(r"\s"), re.compile(r"\S")
        self.ends = np.zeros(max(vocab.values()) + 2, dtype=bool)
        for k, b in self.spelt.items():
            self.ends[k] = b.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n")

    def exact(self, text: str) -> list[int]:
        """By the reference tokenizer, which is only read if a text needs it."""
        if self.whole is None:
            import tokenizers

            self.whole = tokenizers.Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def _stretched(self, text: str) -> bool:
        """Whether a stretch of 2000 characters, counted from a multiple of it, is all white space or
        has none: true for every run of twice that. Each search ends after a few characters."""
        ends = range(_STRETCH, len(text) + 1, _STRETCH)
        return any(not self.space.search(text, k - _STRETCH, k) or not self.ink.search(text, k - _STRETCH, k) for k in ends)

    def __call__(self, text: str) -> np.ndarray:
        if _SPECIAL in text or self._stretched(text):
            return np.array(self.exact(text), dtype="<u4")
        return np.frombuffer(array("I", self.fast.encode_ordinary(text)), dtype=np.uint32).astype("<u4", copy=False)


def _byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest is numbered from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


def merged(*sorted_arrays: np.ndarray) -> np.ndarray:
    """The distinct values of sorted arrays, ascending; a stable sort merges runs."""
    x = np.sort(np.concatenate(sorted_arrays), kind="stable")
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def cut_places(ids: list[np.ndarray], ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may be cut, ascending, and the penalty of each.

    Document ends are free. Between neighbours further apart than half a window, places are added
    at every 1/8 of a window, so that a window can always be filled.
    """
    size = np.array([len(x) for x in ids])
    whole = np.concatenate(ids)
    doc = np.cumsum(size)
    sentence = np.flatnonzero(ends[np.minimum(whole, len(ends) - 1)]) + 1
    places = merged(np.concatenate([[0], sentence]), doc)
    gaps = np.flatnonzero(np.diff(places) > window // 2)
    if len(gaps):
        step = max(1, window // 8)
        more = [np.arange(places[g] + step, places[g + 1], step) for g in gaps]
        forced = np.concatenate(more)
        places = merged(places, forced)
    else:
        forced = np.array([], dtype=np.int64)
    own = np.minimum(np.searchsorted(doc, places, side="left"), len(doc) - 1)
    cost = np.where(size[own] > window, LONG, SHORT)
    cost[np.searchsorted(places, forced)] += ANYWHERE
    cost[np.searchsorted(places, doc)] = 0.0
    cost[0] = 0.0
    return places, cost


def plan(places: np.ndarray, penalty: np.ndarray, window: int, each: float = 0.0) -> np.ndarray:
    """The places of the cheapest cuts, from the first place to the last; a sequence costs ``each``.

    cost[i] = penalty[i] + each + min over j of cost[j] + window - (places[i] - places[j]), that is, the
    sliding minimum of cost[j] + places[j]; and windows of a power of two, which need no padding.
    """
    n = len(places)
    at = np.full(int(places[-1]) + 1, -1, dtype=np.int64)
    at[places] = np.arange(n)
    exact: dict[int, list[int]] = {}
    length = window // 2
    while length >= 8:
        start = places - length
        found = np.flatnonzero(start >= 0)
        found = found[at[start[found]] >= 0]
        for i, j in zip(found.tolist(), at[start[found]].tolist()):
            exact.setdefault(i, []).append(j)
        length //= 2
    p, w = places.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # of (cost + place, place, index), rising
    for i in range(1, n):
        here = p[i]
        while queue[0][1] < here - window:
            queue.popleft()
        best, j = queue[0][0] + window - here, queue[0][2]
        if i in exact:
            for k in exact[i]:
                if cost[k] < best:
                    best, j = cost[k], k
        best += w[i] + each
        cost[i], back[i] = best, j
        value = best + here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, here, i))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return places[np.array(cuts[::-1])]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    No shuffle: each partition is packed by itself, in blocks of a bounded number of ids, and its
    sequences are numbered from its own range.
    """
    schema = f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * keep_ids

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        names, ids, held = [], [], 0
        for b in it:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1)):
                names.append(ident)
                ids.append(np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4"))
                held += len(ids[-1])
                if held >= BLOCK:
                    out, sequence = _pieces(id_col, names, ids, encode.ends, window, sequence, keep_ids)
                    yield out
                    names, ids, held = [], [], 0
        if ids:
            yield _pieces(id_col, names, ids, encode.ends, window, sequence, keep_ids)[0]

    rows, at = numbered(docs, "pk_")
    return rows.select(F.col(at(id_col)).cast("long"), F.col(at(text_col)).cast("string")).mapInArrow(packed, schema)


def _pieces(id_name, names, ids, ends, window, sequence, keep_ids) -> tuple[pa.RecordBatch, int]:
    cuts = plan(*cut_places(ids, ends, window), window, SEQUENCE)
    size = np.array([len(x) for x in ids])
    stop = np.cumsum(size)
    begin = stop - size
    edges = merged(cuts, stop)
    first, last = edges[:-1], edges[1:]
    doc = np.searchsorted(stop, first, side="right")
    window_of = np.searchsorted(cuts, first, side="right") - 1
    start, length = first - begin[doc], last - first
    raw = [ids[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())]
    cols = [
        pa.array([names[d] for d in doc.tolist()], pa.int64()),
        pa.array(start), pa.array(length),
        pa.array([crc32(x.tobytes()) for x in raw], pa.int64()),
        pa.array(size[doc]), pa.array(sequence + window_of), pa.array(first - cuts[window_of]),
    ]
    head = [id_name, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if keep_ids:
        cols.append(pa.array([x.astype(np.int64) for x in raw], pa.list_(pa.int64())))
        head.append("ids")
    return pa.RecordBatch.from_arrays(cols, names=head), sequence + len(cuts) - 1
