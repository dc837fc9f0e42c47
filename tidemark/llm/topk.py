"""Exact top-k inner products: columnar branch and bound."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, read

CANDIDATES, QUERIES = 1024, 256  # vectors in a block
STEP = 8  # dimensions that are accumulated before candidates are bounded again
EXACT = float(1 << 53)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def packed(columns: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them all (i1 to i4, else doubles), and the type's name."""
    top = np.abs(columns).max(initial=0)
    kind = next((f"<i{n}" for n in (1, 2, 4) if top < 1 << (8 * n - 1)), "<f8")
    return kind, np.ascontiguousarray(columns).astype(kind).tobytes()


def _blocks(size: int, scale: int, only: int):
    """Packs vectors to blocks of one dimension in vertical layout: all first components, then all second ones ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            kind, columns = packed(np.floor(np.array(rows, dtype=np.float64).reshape(len(ids), dim) * scale).T)
            ids = np.array(ids, dtype="<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([int(ids.min())], pa.int64()), pa.array([kind]), pa.array([ids.tobytes()]), pa.array([columns])],
                ["dim", "first", "kind", "ids", "columns"],
            )

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec_id is None or vector is None or (only and vec_id % only):
                    continue
                if any(x is None or not math.isfinite(x) for x in vector):
                    continue
                ids, rows = held.setdefault(len(vector), ([], []))
                ids.append(vec_id)
                rows.append(vector)
                if len(ids) == size:
                    yield block(len(vector))
        for dim in sorted(held):
            yield block(dim)

    return run


BLOCK = "dim int, first long, kind string, ids binary, columns binary"


def opened(kind: str, raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(dim, n).astype(np.float64)


def search(q: np.ndarray, c: np.ndarray, q_ids: np.ndarray, c_ids: np.ndarray, k: int, least: np.ndarray):
    """The k best candidates of each query in one block: (query index, candidate index, score).

    q, c: (dim, n) whole numbers. least: for each query a score that k candidates seen elsewhere reach; candidates that
    can't reach it are dropped, and it is raised in place. Dimensions with the largest candidates come first. After
    each STEP of them, a candidate's score can still change by the product of both vectors' remaining lengths at most
    (Cauchy-Schwarz). Candidates whose upper bound is below the k-th best lower bound are compacted away.
    """
    dim, n = c.shape
    order = np.argsort(-(c**2).sum(axis=1), kind="stable")
    q, c = q[order], c[order]
    exact = dim * np.abs(c).max(initial=0) * np.abs(q).max(initial=0) < EXACT
    if not exact:
        rows = [(i, j, sum(int(a) * int(b) for a, b in zip(q[:, i], c[:, j]))) for i in range(q.shape[1]) for j in range(n) if q_ids[i] != c_ids[j]]
        best = sorted(((i, j, min(max(s, LOWEST), HIGHEST)) for i, j, s in rows), key=lambda r: (r[0], -r[2], c_ids[r[1]]))
        out, seen = [], {}
        for i, j, s in best:
            seen[i] = seen.get(i, 0) + 1
            if seen[i] <= k:
                out.append((i, j, s))
        return out
    rest_q = np.sqrt(np.cumsum((q**2)[::-1], axis=0)[::-1])
    rest_c = np.sqrt(np.cumsum((c**2)[::-1], axis=0)[::-1])
    first = min(2 * STEP, dim)
    start = q[:first].T @ c[:first]  # all queries at once, before anything is dropped
    out = []
    for i in range(q.shape[1]):
        alive = np.nonzero(c_ids != q_ids[i])[0]
        score, done = start[i, alive], first
        while done < dim and len(alive) > k:
            slack = rest_q[done, i] * rest_c[done, alive] * (1 + 1e-9) + 1e-6
            bar = max(least[i], np.partition(score - slack, len(alive) - k)[len(alive) - k])
            keep = score + slack >= bar
            alive, score = alive[keep], score[keep]
            step = min(STEP if len(alive) > 64 else dim, dim - done)
            score = score + q[done : done + step, i] @ c[done : done + step, alive]
            done += step
        if done < dim:
            score = score + q[done:, i] @ c[done:, alive]
        top = np.lexsort((c_ids[alive], -score))[:k]
        if len(top) == k:
            least[i] = max(least[i], score[top[-1]])
        out += [(i, alive[t], int(score[t])) for t in top if score[t] >= least[i]]
    return out


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # the bars of the last few query blocks seen by this task
        for batch in batches:
            for dim, q_kind, q_raw, q_cols, bars, c_kind, c_raw, c_cols in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, c_ids = np.frombuffer(q_raw, "<i8"), np.frombuffer(c_raw, "<i8")
                q, c = opened(q_kind, q_cols, dim, len(q_ids)), opened(c_kind, c_cols, dim, len(c_ids))
                if len(known) > 64:
                    known.clear()
                # a block's ids and columns, as an id may have several vectors
                least = known.setdefault(q_raw + q_cols, np.frombuffer(bars, "<f8").copy())
                marks = [xxhash.xxh64_intdigest(np.ascontiguousarray(q[:, i]).tobytes()) >> 1 for i in range(q.shape[1])]
                found = search(q, c, q_ids, c_ids, k, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(q_ids[i]) for i, *_ in found], pa.int64()),
                        pa.array([marks[i] for i, *_ in found], pa.int64()),
                        pa.array([int(c_ids[j]) for _, j, _ in found], pa.int64()),
                        pa.array([s for *_, s in found], pa.int64()),
                    ],
                    ["query_id", "mark", "vec_id", "score"],
                )

    return run


def _bars(k: int):
    """Query blocks with, for each query, the score that k candidates of one block reach: what any task begins with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bars = []
            for dim, q_kind, q_raw, q_cols, c_kind, c_raw, c_cols in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, c_ids = np.frombuffer(q_raw, "<i8"), np.frombuffer(c_raw, "<i8")
                q, c = opened(q_kind, q_cols, dim, len(q_ids)), opened(c_kind, c_cols, dim, len(c_ids))
                least = np.full(len(q_ids), -np.inf)
                search(q, c, q_ids, c_ids, k, least)
                bars.append(least.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bars, pa.binary())], ["dim", "q_kind", "q_ids", "q_columns", "bars"])

    return run


#: Candidate blocks of a group: at least as many as leave each of the cluster's cores some groups, at most as many as a task
#: reads in good time. Each query block is copied once for every group, so larger groups move less.
GROUP, TASKS = 64, 4


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query, ties to the smaller vec_id.

    Components become floor(scale * x). Queries are the vectors whose vec_id `every` divides, candidates all others
    than the query's own id. Vectors that are null or hold null or non-finite components, and rows without id, take no
    part; vectors of different lengths aren't compared; an empty vector has score 0 with every other. Rows that repeat an
    id are candidates each; an id with several distinct vectors is a query with each of them, each with ranks from 1.
    Fewer than k candidates give fewer rows, an empty table none. Products beyond 64 bits count as the largest long.
    Other columns are not looked at.

    Vectors are packed to blocks in vertical layout. Each block of queries meets each block of candidates once, as the
    query set is stated against all rows: query blocks are repeated for every group of candidate blocks and joined by
    the group's number, so a task holds one pair of blocks at a time whatever the size of the table. One block of
    candidates is met by all queries first; the scores that it gives them are the bars that all tasks begin with.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    candidates = checkpointed(rows.mapInArrow(_blocks(CANDIDATES, scale, 0), BLOCK))
    queries = checkpointed(rows.filter(F.col("vec_id") % every == 0).distinct().mapInArrow(_blocks(QUERIES, scale, every), BLOCK))
    n, cores = candidates.count(), vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(n // 2, max(n // GROUP, TASKS * cores)))
    group = F.pmod(F.xxhash64("dim", "first", "ids", "columns"), F.lit(groups))
    left = candidates.select("dim", group.alias("g"), *[F.col(c).alias(f"c_{c}") for c in ("kind", "ids", "columns")])
    # one block of each length gives every query a bar, so that bounds prune from the start in all tasks
    one = left.groupBy("dim").agg(F.min_by(F.struct("c_kind", "c_ids", "c_columns"), F.xxhash64("c_ids", "c_columns")).alias("c")).select("dim", "c.*")
    asked = queries.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("kind", "ids", "columns")]).join(checkpointed(one), "dim")
    asked = checkpointed(asked.mapInArrow(_bars(k), "dim int, q_kind string, q_ids binary, q_columns binary, bars binary"))
    right = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    met = right.join(left, ["dim", "g"]).select("dim", "q_kind", "q_ids", "q_columns", "bars", "c_kind", "c_ids", "c_columns")
    found = met.mapInArrow(_pairs(k), "query_id long, mark long, vec_id long, score long")
    by_score = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: query_id, rank, vec_id, score."""
    return top_k(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
with usable as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
    from usable q join usable c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
