"""SimHash near-dedup by a binary trie self-join.

Fingerprints of 64 bits are linked when they differ in at most ``budget`` bits. Distinct
fingerprints (copies collapse first) are dealt out by their leading bits: two trie nodes meet in
one task when their prefixes differ in at most ``budget`` bits. There both subtries are traversed
together, level by level, adding up differing bits and pruning a pair of nodes once the budget is
exceeded. A task returns a spanning forest of its links, never all pairs, and components are then
found by contraction in rounds that are written to the shared folder.

Edge cases: a null or wordless text has fingerprint 0 and is linked like any other; one or two
words are one shingle; ids are of an integer type, null ids sort after all others; repeated rows share
a component. A very long text is hashed whole, CHUNK shingles at a time. All columns of the input pass
through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, materialise, numbered, renamed

SEED = 42
#: Odd, so that multiplying by it is a bijection of 64-bit numbers: node ids in random order.
MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8, dtype=np.int64) * 256)[None, :]
#: Shingles hashed at once, for memory on very long texts.
CHUNK = 1 << 18
#: Pairs of trie nodes handled at once.
FRONT = 1 << 18


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(2048, dtype=np.int64)
    for k in range(0, len(starts), CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])], dtype="<u8")
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", counts.reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", fp: str = "fp", node: str = "node", shingle: int = 3, keep_text: bool = True) -> DataFrame:
    """Append the fingerprint and the node id (both as signed longs). Arrow batches, no shuffle."""
    kept = docs.columns if keep_text else [c for c in docs.columns if c != text_col]
    fields = [f for f in docs.schema.fields if f.name in kept]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(text_col).cast(pa.binary())
            h = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in texts), dtype=np.uint64, count=len(texts))
            cols = [b.column(c) for c in kept] + [pa.array(h.view(np.int64)), pa.array((h * MIX).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, fp, node])

    return docs.mapInArrow(batches, T.StructType([*fields, T.StructField(fp, T.LongType()), T.StructField(node, T.LongType())]))


def _link(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; ``parent`` is and stays flat."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def trie_links(a: np.ndarray, b: np.ndarray | None, budget: int) -> np.ndarray:
    """A flat forest over a's and then b's places that connects what lies within ``budget`` bits.

    ``a`` and ``b`` are sorted distinct uint64; without ``b``, ``a`` is joined with itself. A trie
    node is a range of the sorted array. ``[lo_a, hi_a, lo_b, hi_b, differing bits]`` are columns of
    the frontier; pairs of small nodes are compared directly.
    """
    own = b is None
    other, shift = (a, 0) if own else (b, len(a))
    parent = np.arange(len(a) + (0 if own else len(b)))
    if not len(a) or not len(other):
        return parent
    stack = [(63, np.array([[0], [len(a)], [0], [len(other)], [0]], dtype=np.int64))]
    while stack:
        depth, front = stack.pop()
        if front.shape[1] > FRONT:
            half = front.shape[1] // 2
            stack += [(depth, front[:, :half]), (depth, front[:, half:])]
            continue
        na, nb = front[1] - front[0], front[3] - front[2]
        small = (na * nb <= 16) | (depth < 0)
        if small.any():
            _compare(a, other, shift, own, front[:, small], budget, parent)
            front = front[:, ~small]
        if not front.shape[1]:
            continue
        mid = [_middle(x, front[k], front[k + 1], depth) for x, k in ((a, 0), (other, 2))]
        zero_a, one_a = (front[0], mid[0]), (mid[0], front[1])
        zero_b, one_b = (front[2], mid[1]), (mid[1], front[3])
        mirror = own & (front[0] == front[2]) & (front[1] == front[3])
        parts = []
        for left, right, cost, open_ in ((zero_a, zero_b, 0, None), (one_a, one_b, 0, None), (zero_a, one_b, 1, None), (one_a, zero_b, 1, ~mirror)):
            err = front[4] + cost
            ok = (left[1] > left[0]) & (right[1] > right[0]) & (err <= budget)
            ok = ok if open_ is None else ok & open_
            parts.append(np.stack([left[0][ok], left[1][ok], right[0][ok], right[1][ok], err[ok]]))
        stack.append((depth - 1, np.concatenate(parts, axis=1)))
    return parent


def _middle(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where, within [lo, hi) of common leading bits, bit ``depth`` becomes 1."""
    bit = np.uint64(1) << np.uint64(depth)
    head = x[lo] & ~(bit | (bit - np.uint64(1)))
    return np.clip(np.searchsorted(x, head | bit), lo, hi)


def _compare(a, other, shift, own, front, budget, parent) -> None:
    na, nb = front[1] - front[0], front[3] - front[2]
    n = na * nb
    for k in range(0, len(n), 1 << 14):
        part = slice(k, k + (1 << 14))
        m, w = n[part], nb[part]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        wide = np.repeat(w, m)
        i, j = np.repeat(front[0][part], m) + at // wide, np.repeat(front[2][part], m) + at % wide
        near = np.bitwise_count(a[i] ^ other[j]) <= budget
        near &= (i < j) if own else True
        if near.any():
            _link(parent, i[near], j[near] + shift)


def trie_join(prints: DataFrame, budget: int = 2, leaf: int = 2048) -> DataFrame:
    """Distinct (fp, node) -> edges (a, b) between nodes that span the links.

    Each fingerprint is sent to the 1 + p + p(p-1)/2 pairs of p-bit prefixes within two bits, p
    being the logarithm of the number of fingerprints over ``leaf``.
    """
    n = prints.count()
    p = min(32, max(0, int(np.ceil(np.log2(max(1, n) / leaf)))))
    masks = [sum(1 << k for k in c) for r in range(budget + 1) for c in combinations(range(p), r)]
    head = F.shiftrightunsigned("fp", 64 - p).cast("int") if p else F.lit(0)
    pairs = prints.withColumn("head", head).withColumn("mask", F.explode(F.array(*map(F.lit, masks))))
    to = F.col("head").bitwiseXOR(F.col("mask"))
    pairs = pairs.select("fp", "node", F.least("head", to).alias("lo"), F.greatest("head", to).alias("hi"), (F.col("head") > to).alias("right"))

    def join(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy().view(np.uint64)
        node, right = group["node"].to_numpy(), group["right"].to_numpy(zero_copy_only=False)
        own = group["lo"][0].as_py() == group["hi"][0].as_py()
        sides = []
        for side in (False,) if own else (False, True):
            here = np.flatnonzero(right == side)
            sides.append(here[np.argsort(fp[here])])
        if len(sides) == 2 and not (len(sides[0]) and len(sides[1])):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        parent = trie_links(fp[sides[0]], None if own else fp[sides[1]], budget)
        ids = node[np.concatenate(sides)]
        moved = np.flatnonzero(parent != np.arange(len(parent)))
        return pa.table({"a": ids[moved], "b": ids[parent[moved]]})

    return pairs.groupBy("lo", "hi").applyInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b) -> (node, root), for nodes that have an edge.

    Rounds of contraction: each node points to its least neighbour, edges move to what their ends
    point at, and loops go. Ids are in random order, so the number of nodes falls by a constant
    factor in expectation. Every round is written to the shared folder; nothing is collected.
    """
    edges = materialise(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        step = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        step = materialise(step, "cc-step")
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
        else:
            then = step.select(F.col("node").alias("root"), "to")
            roots = roots.join(then, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = materialise(roots, "cc-roots")
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        edges = moved.where("a2 != b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = materialise(edges, "cc-edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(printed: DataFrame, id_col: str = "doc_id", budget: int = 2) -> DataFrame:
    """Rows with fp and node -> (fp, least): the least id that each fingerprint can reach.

    Copies collapse into one fingerprint map-side before anything is joined.
    """
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    prints = materialise(printed.groupBy("fp", "node").agg(F.min(ident).alias("least")), "prints")
    roots = components(trie_join(prints.select("fp", "node"), budget))
    rooted = prints.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    least = least.select(F.col("root").bitwiseXOR(F.lit(0)).alias("root"), "component")
    return rooted.join(least, "root").select("fp", F.col("component").alias("least"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 2, shingle: int = 3) -> DataFrame:
    """Keep one row of each component: the one with the least id (of repeated rows, the first)."""
    names = docs.columns
    rows, at = numbered(docs, "si_")
    rows = rows.withColumn("si_row", F.monotonically_increasing_id())
    printed = materialise(with_fingerprints(rows, at(text_col), shingle=shingle), "simhash")
    slim = printed.select("si_row", "fp", F.coalesce(F.col(at(id_col)).cast("long"), F.lit(NULL_ID)).alias("si_id"))
    least = materialise(simhash_components(printed, at(id_col), budget), "simhash-least")
    # Only rows that hold their component's least id can stay; a tie is settled by row.
    held = slim.join(least, "fp").where(F.col("si_id") == F.col("least"))
    stay = held.groupBy("least").agg(F.min("si_row").alias("si_row")).select(F.col("si_row").bitwiseXOR(F.lit(0)).alias("si_row"))
    return printed.join(stay, "si_row", "left_semi").select(*renamed("si_", names))
