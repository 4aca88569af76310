"""Approximate nearest neighbours with an inverted multi-index.

Each half of the vectors is quantised by a codebook of its own; a row's cell is its pair of
centroids. A query walks the pairs in the order of their summed nearness with a heap until the
cells hold ``probe`` of all rows, and the entries of those cells are reranked by the exact inner
product, in double precision.

The codebooks are fitted on a bounded sample: the rows with the least hash of their id, SAMPLE of them
or SAMPLE_EACH for each centroid, if that is more. The number of centroids grows with the square root
of the rows, up to MOST_CENTROIDS. ``probe`` is found on the same sample, by exact search in it: the
least share with which its queries find TARGET of their neighbours. So it is small where the vectors
have clusters, and large where they have none.

All rows are indexed. Cells are gathered into blocks (a larger cell is split over several), queries of
neighbouring cells into chunks of CHUNK. A block meets the chunks that hold a query of its cells, and
no others; a task reranks one chunk against one block and returns the k best of each query. No task
or key grows beyond these sizes.

Edge cases: null or zero vectors and those with null or non-finite components take no part, nor do
vectors whose length is not the most frequent one; ids are of an integer type, null ids take no part;
ties go to the smaller id; repeated rows are candidates each; other columns, whatever their names, are
not read. Fewer candidates than k give all of them. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SAMPLE, SAMPLE_EACH = 8192, 128
CENTROIDS, MOST_CENTROIDS = 32, 256
#: Shares of all rows that a query's cells hold at least, of which one is chosen; the recall it is to
#: give in the sample; and how many rows of the sample ask.
PROBES, TARGET, ASKING = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0), 0.95, 256
#: Rows of a block: a PARTS-th of all, within these bounds; and queries of a chunk.
BLOCK, MOST_BLOCK, PARTS, CHUNK = 2048, 65536, 16, 16384


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 3) -> np.ndarray:
    """Lloyd's algorithm; a centroid without rows keeps its place."""
    rng = np.random.default_rng(seed)
    own = np.unique(x, axis=0)
    c = own[rng.permutation(len(own))[:k]]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(axis=0)
    return c


def walk(near1: np.ndarray, near2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(near2) + j) by falling near1[i] + near2[j] until they hold ``enough`` rows."""
    o1, o2 = np.argsort(-near1, kind="stable").tolist(), np.argsort(-near2, kind="stable").tolist()
    a, b = near1[o1].tolist(), near2[o2].tolist()
    n2, have, cells = len(o2), 0, []
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * n2 + o2[j]
        if counts[cell]:
            cells.append(cell)
            have += int(counts[cell])
        if j + 1 < n2:
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(o1):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return cells


def least_probe(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, target: float = TARGET) -> float:
    """The least of PROBES with which rows of ``x`` find ``target`` of their k nearest others in ``x``."""
    c1, c2 = books
    half = c1.shape[1]
    cells = nearest(x[:, :half], c1) * len(c2) + nearest(x[:, half:], c2)
    counts = np.bincount(cells, minlength=len(c1) * len(c2))
    held = np.cumsum(counts[counts > 0])
    need = []  # for each neighbour, the share of rows that the walk has seen when it is found
    for q in np.linspace(0, len(x) - 1, min(ASKING, len(x))).astype(int):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        order = np.array(walk(c1 @ x[q, :half], c2 @ x[q, half:], counts, len(x)))
        before = np.cumsum(counts[order]) - counts[order]  # a walk stops once it holds enough
        place = np.empty(len(counts))
        place[order] = before
        need.append(place[cells[best]] / held[-1])
    need = np.concatenate(need) if need else np.zeros(0)
    return next((p for p in PROBES if not len(need) or (need < p).mean() >= target), 1.0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroid of each row."""
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1).astype(np.int64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def blocks_of(counts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each cell its first block and how many it has; and the number of blocks."""
    first, parts, at, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, block
    for c, n in enumerate(counts.tolist()):
        if n > block:
            if room < block:
                at += 1
            first[c], parts[c] = at, -(-n // block)
            at, room = at + parts[c], block
            continue
        if n > room:
            at, room = at + 1, block
        first[c] = at
        room -= n
    return first, parts, int(at) + 1


def search(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", centroids: int | None = None, sample: int | None = None, probe: float | None = None, block: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``queries``: a condition on the rows' id column."""
    spark = rows.sparkSession
    out = "query_id long, vec_id long, score double"
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes["dim"], sizes["count"]
    good = good.where(F.size("v") == dim)
    centroids = centroids or min(MOST_CENTROIDS, max(CENTROIDS, int(np.sqrt(total) / 8)))
    sample = sample or max(SAMPLE, SAMPLE_EACH * centroids)
    # The least hashes are among the least 2 * sample / total of all hashes; others are not sorted.
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    picked = good.where(part <= 2.0 * sample / total).select("id", "v").orderBy(part, "id").limit(sample).toArrow()
    x = _matrix(picked["v"].combine_chunks(), dim)
    half = max(1, dim // 2)
    fitted = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids) if dim > half else np.zeros((1, 0))
    books = spark.sparkContext.broadcast(fitted)
    probe = least_probe(x, fitted, k) if probe is None else probe

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c1, c2 = books.value
        for b in it:
            if b.num_rows:
                v = _matrix(b.column("v"), dim)
                cell = nearest(v[:, :half], c1) * len(c2) + nearest(v[:, half:], c2)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["id", "v", "asks", "cell"])

    index = materialise(good.mapInArrow(assign, "id long, v array<double>, asks boolean, cell long"), "ann-index")
    # One row for each cell: at most centroids squared.
    found = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks")).collect()
    counts, asking = np.zeros((2, len(fitted[0]) * len(fitted[1])), dtype=np.int64)
    for r in found:
        counts[r["cell"]], asking[r["cell"]] = r["n"], r["asks"]
    block = block or min(MOST_BLOCK, max(BLOCK, -(-total // PARTS)))
    enough = max(k + 1, int(np.ceil(probe * total)))
    first, parts, _ = blocks_of(counts, block)
    layout = spark.sparkContext.broadcast((counts, first, parts, *blocks_of(asking, chunk)[:2]))

    def dealt(b: pa.RecordBatch, first: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Blocks (or chunks) of rows, those of a large cell spread over its parts."""
        cell, ident = b.column("cell").to_numpy(), b.column("id").to_numpy()
        salt = ((ident.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
        return first[cell] + salt % parts[cell]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("cell"), pa.array(dealt(b, *layout.value[1:3]))], names=["id", "v", "cell", "block"])

    def probes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (c1, c2), (counts, first, parts, *chunked) = books.value, layout.value
        for b in it:
            ids, vs, cells_, blocks_, chunks_ = [], [], [], [], []
            for ident, v, at_chunk in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), dealt(b, *chunked).tolist()):
                q = np.array(v)
                by: dict[int, list[int]] = {}
                for c in walk(c1 @ q[:half], c2 @ q[half:], counts, enough):
                    for p in range(int(parts[c])):
                        by.setdefault(int(first[c]) + p, []).append(c)
                for at, cs in by.items():
                    ids.append(ident)
                    vs.append(v)
                    cells_.append(cs)
                    blocks_.append(at)
                    chunks_.append(at_chunk)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.list_(pa.float64())), pa.array(cells_, pa.list_(pa.int32())), pa.array(blocks_, pa.int64()), pa.array(chunks_, pa.int64())], names=["id", "v", "cells", "block", "chunk"])

    def rerank(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        q, v = _matrix(left["v"].combine_chunks(), dim), _matrix(right["v"].combine_chunks(), dim)
        qid, vid = left["id"].to_numpy(), right["id"].to_numpy()
        cells, place = np.unique(right["cell"].to_numpy(), return_inverse=True)
        got = []
        step = max(1, (1 << 21) // len(v))  # scores held at once
        for s in range(0, len(q), step):
            part = slice(s, s + step)
            score = q[part] @ v.T
            seen = np.zeros((score.shape[0], len(cells)), dtype=bool)
            for r, cs in enumerate(left["cells"].slice(s, step).to_pylist()):
                at = np.searchsorted(cells, cs)
                at = np.minimum(at, len(cells) - 1)
                seen[r, at[cells[at] == np.array(cs)]] = True
            score[~seen[:, place]] = -np.inf
            score[vid[None, :] == qid[part][:, None]] = -np.inf
            kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
            # Products from a matrix product may differ in the last bits between equal vectors:
            # all within a hair of the k-th are scored again, adding up in order.
            for r in range(len(score)):
                near = np.flatnonzero((score[r] >= kth[r] - 1e-9 * max(1.0, abs(kth[r]) if np.isfinite(kth[r]) else 1.0)) & np.isfinite(score[r]))
                if len(near):
                    exact = np.cumsum(v[near] * q[s + r], axis=1)[:, -1]
                    best = np.lexsort((vid[near], -exact))[:k]
                    got.append((np.full(len(best), qid[s + r]), vid[near][best], exact[best]))
        if not got:
            return empty
        a, b, c = (np.concatenate(z) for z in zip(*got))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    left = materialise(index.where("asks").select("id", "v", "cell").mapInArrow(probes, "id long, v array<double>, cells array<int>, block long, chunk long"), "ann-probes")
    meet = left.select(F.col("block").alias("to"), F.col("chunk").alias("asked")).distinct()
    right = index.mapInArrow(place, "id long, v array<double>, cell long, block long").join(meet, F.col("block") == F.col("to")).drop("to")
    best = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "asked")).applyInArrow(rerank, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
