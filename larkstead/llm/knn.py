"""Exact top-k search by a Voronoi kNN join.

Vectors become whole numbers, floor(1024 * x) of each component; the score is their inner
product. With one more coordinate, sqrt(M^2 - |v|^2) for data and 0 for queries (M the longest
norm), the highest inner products are the nearest points. Pivots, a bounded sample, cut space into
cells. Per cell, a summary holds the distances of its k + 1 ids nearest to the pivot; from the
summaries follows, for each cell of queries, a distance within which all its queries have their
k neighbours. A row goes to a block of queries only if the triangle inequality allows it that
near; each (block, chunk of a cell) is then solved on its own, and the best k are merged.

Rows whose id or vector is null, or whose vector is empty or holds null or non-finite components,
take no part. Shorter vectors count as padded by zeros. Rows with one id are one query, and none
of them is its candidate; candidates with one id and one score count once. Scores are exact below 2**63. Fewer than k candidates give fewer rows; an
empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import map_batches, saved

SCALE = 1024
#: Pivots grow with the root of the rows between these; the upper one bounds what the driver holds.
PIVOTS = 64, 1024
#: Queries of a block and rows of a chunk at most, about: what a task holds, whatever the data.
BLOCK, CHUNK = 32768, 16384
#: Queries scored at once.
STRIP = 64


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id long, v binary of little-endian int64, norm2 double) of the rows that take part."""

    def make(batches):
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    rows.append(np.floor(SCALE * x).astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array([float(x.astype(float) @ x.astype(float)) for x in rows], pa.float64())], names=["id", "v", "norm2"])

    return map_batches(vectors.select(F.col(id_column).cast("long"), F.col(vector_column)), make, "id long, v binary, norm2 double")


def matrix(column: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for row, raw in zip(out, column, strict=True):
        x = np.frombuffer(raw, "<i8")
        row[: len(x)] = x
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, which have one coordinate more than whole vectors."""
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0))


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int | None = None, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every row for each query row. ``is_query`` is a condition on column ``id``."""
    rows = saved(quantised(vectors, id_column, vector_column))
    count, top2, width = rows.agg(F.count(F.lit(1)), F.max("norm2"), F.max(F.length("v"))).first()
    width = (width or 0) // 8
    pivots = pivots or min(PIVOTS[1], max(PIVOTS[0], int(count**0.5) // 2))
    long2 = (top2 or 0.0) * (1 + 1e-9)
    chosen = rows.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(pivots).collect()
    whole = matrix([bytes(r["v"]) for r in chosen], width).astype(float)
    points = np.hstack([whole, np.sqrt(np.maximum(long2 - (whole * whole).sum(1), 0))[:, None]]) if chosen else np.zeros((0, width + 1))
    slack = 1e-6 * (np.sqrt(long2) + 1)

    def assign(as_query: bool):
        def f(batches):
            for batch in batches:
                x = matrix(batch.column(1).to_pylist(), width).astype(float)
                last = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(long2 - (x * x).sum(1), 0))
                d = distances(np.hstack([x, last[:, None]]), points)
                cell = d.argmin(1) if len(x) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], names=["id", "v", "cell", "dist"])

        return f

    schema = "id long, v binary, cell int, dist double"
    data = saved(map_batches(rows.select("id", "v"), assign(False), schema))
    queries = saved(map_batches(rows.where(is_query).select("id", "v"), assign(True), schema))

    # Summaries: at most pivots * (k + 1) rows, one an id in each cell.
    by_cell = W.Window.partitionBy("cell").orderBy("dist", "id")
    near = data.groupBy("cell", "id").agg(F.min("dist").alias("dist")).withColumn("r", F.row_number().over(by_cell)).where(F.col("r") <= k + 1).collect()
    cells = data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).collect()
    sizes = {r["cell"]: r["n"] for r in cells}
    spans = {r["cell"]: (r["near"], r["far"]) for r in cells}
    groups = {r["cell"]: (r["far"], r["n"]) for r in queries.groupBy("cell").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    between = distances(points, points)
    near_cell, near_dist, near_id = (np.array([r[c] for r in near]) for c in ("cell", "dist", "id"))
    chunks = {c: -(-n // chunk) for c, n in sizes.items()}

    # Blocks of query cells; a large cell has several blocks. reach[cell]: how far its queries must look.
    base, reach, blocks, last, held = {}, {}, {}, 0, 0
    for c, (far, n) in sorted(groups.items()):
        bound = between[c][near_cell] + near_dist if len(near) else np.empty(0)
        # One distance an id: of k + 1 ids, k are candidates.
        order = np.argsort(bound)
        bound = bound[np.sort(order[np.unique(near_id[order], return_index=True)[1]])] if len(near) else bound
        bound.sort()
        # A query at distance d of its pivot has its k neighbours within this and d.
        base[c] = bound[k] + slack if len(bound) > k else np.inf
        reach[c] = (far, base[c] + far)
        if held and held + n > block:
            last, held = last + 1, 0
        parts = -(-n // block)
        blocks[c] = (last, parts)
        last, held = (last + parts - 1, held + n) if parts == 1 else (last + parts, 0)
    wanted: dict[int, list[tuple[int, float, float]]] = {c: [] for c in sizes}
    needs: dict[int, list[int]] = {c: [] for c in groups}
    for c, (far, theta) in reach.items():
        for j in sizes:
            low, high = between[c][j] - far - theta - slack, between[c][j] + far + theta + slack
            if low > spans[j][1] or high < spans[j][0]:
                continue
            needs[c].append(j)
            wanted[j] += [(blocks[c][0] + i, low, high) for i in range(blocks[c][1])]
    pairs = last + 1

    def deal_data(batches):
        for batch in batches:
            cell, dist, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 0))
            take, keys = [], []
            for c in np.unique(cell):
                own = np.flatnonzero(cell == c)
                part = (ids[own] // 100 + ids[own]) % chunks[c]
                allowed: dict[int, np.ndarray] = {}
                for b, low, high in wanted[int(c)]:
                    allowed[b] = allowed.get(b, False) | ((dist[own] >= low) & (dist[own] <= high))
                for b, yes in allowed.items():
                    take.append(own[yes])
                    keys.append((int(c) << 40 | part[yes] << 20) + b)
            take, keys = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (take, keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(batch.column(i).take(pa.array(take)) for i in (0, 1))], names=["pair", "id", "v"])

    def deal_queries(batches):
        for batch in batches:
            cell, dist, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 0))
            take, keys = [], []
            for c in np.unique(cell).tolist():
                own = np.flatnonzero(cell == c)
                first, parts = blocks[c]
                wide = 2 * dist[own] + base[c] + slack
                mine = first + (ids[own] // 100) % parts
                for j in needs[c]:
                    # Only queries whose own distance allows the cell.
                    yes = (between[c][j] - wide <= spans[j][1]) & (between[c][j] + wide >= spans[j][0])
                    for part in range(chunks[j]):
                        take.append(own[yes])
                        keys.append((j << 40 | part << 20) + mine[yes])
            take, keys = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (take, keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(i).take(pa.array(take)) for i in (0, 1))], names=["pair", "id", "v"])

    def solve(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        q, v = matrix(mine["v"].to_pylist(), width), matrix(theirs["v"].to_pylist(), width)
        qid, vid = mine["id"].to_numpy(), theirs["id"].to_numpy()
        repeated = len(np.unique(vid)) < len(vid)
        exact = long2 < 2**53  # no partial sum exceeds M^2
        kind = np.float64 if exact else np.int64
        q, v = q.astype(kind), v.astype(kind).T
        out = []
        for at in range(0, len(q) if len(vid) else 0, STRIP):
            for own, scores in zip(qid[at : at + STRIP], q[at : at + STRIP] @ v, strict=True):
                other = vid != own
                if repeated:  # candidates with one id and one score count once
                    order = np.lexsort((vid, -scores))
                    same = (vid[order[1:]] == vid[order[:-1]]) & (scores[order[1:]] == scores[order[:-1]])
                    other[order[1:][same]] = False
                best = top(scores[other], vid[other], k)
                out.append((np.full(len(best), own), vid[other][best], scores[other][best].astype(np.int64)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    parts = max(8, min(len(sizes) * pairs, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4))
    dealt = "pair long, id long, v binary"
    left = map_batches(queries, deal_queries, dealt).repartition(parts, "pair")
    right = map_batches(data, deal_data, dealt).repartition(parts, "pair")
    found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(solve, "query_id long, vec_id long, score long")
    ranked = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
