"""Approximate nearest neighbours by inner product, with randomly rotated one-bit codes.

Each vector, less the mean, is rotated at random; its code is the signs. With its length and
the cosine between code and vector, packed bits estimate an inner product without bias, and the
same scalars bound the error. A query keeps the vectors whose upper bound reaches the
k-th best exact score among those of the best estimates, and only those are scored exactly. Queries meet all vectors in blocks: a task holds
one block of queries and one slice of vectors, so memory does not grow with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import staged

#: Standard deviations of the estimate that its bound allows for: about one true neighbour in a
#: thousand lies beyond.
EPSILON = 3.0
#: Vectors scored exactly for each neighbour wanted, before any are pruned.
FIRST = 5
#: Queries of a block and vectors of a slice.
BLOCK, SLICE = 4096, 32768
SEED = 11


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def rotation(width: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, length of the residual, cosine of code and residual) of each row."""
    rest = (vectors - mean) @ turn
    length = np.linalg.norm(rest, axis=1)
    cosine = np.abs(rest).sum(axis=1) / (np.maximum(length, 1e-300) * math.sqrt(vectors.shape[1]))
    return np.packbits(rest > 0, axis=1), length, np.where(length > 0, cosine, 1.0)


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


@dataclass(frozen=True)
class Index:
    """`rows` (id, vector, code, length, cosine), and the mean and rotation of their codes."""

    rows: DataFrame
    mean: np.ndarray
    turn: np.ndarray


def index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED) -> Index:
    """An index with one row per usable row of `vectors`, in the shared folder.

    The width is the most frequent one (ties to the larger); vectors of another are not usable.
    Rows with a null id are left out, since no result could name them. Ids are whole numbers:
    they are cast to long, and where a string is none the cast fails the query (ANSI mode) or
    gives a null id.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector")))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    top = widths.orderBy(F.col("n").desc(), F.col("width").desc()).first()
    width = top["width"] if top else 1
    rows = rows.filter(F.size("vector") == width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(width), 0
        for batch in batches:
            total += _stacked(batch.column(0), width).sum(axis=0)
            count += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([count])], ["total", "n"])

    # One row per task: the sums of its vectors.
    parts = rows.select("vector").mapInArrow(sums, "total array<double>, n long")
    each = parts.select(F.posexplode("total").alias("i", "x"), "n").groupBy("i").agg((F.sum("x") / F.greatest(F.sum("n"), F.lit(1))).alias("x"))
    mean = np.zeros(width)
    for r in each.collect():
        mean[r["i"]] = r["x"]
    turn = rotation(width, seed)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, length, cosine = encode(_stacked(batch.column("vector"), width), mean, turn)
                own = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(cosine)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], ["id", "vector", "code", "length", "cosine"])

    coded = rows.mapInArrow(codes, "id long, vector array<double>, code binary, length double, cosine double")
    return Index(staged(coded, "codes"), mean, turn)


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in order of the components: equal rows give equal sums."""
    return np.add.accumulate(left * right, axis=1)[:, -1] if len(left) else np.zeros(0)


def _best(queries: pa.Table, rows: pa.Table, mean: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> pa.Table:
    """The k best rows of a slice for each query of a block, by bounds and then exactly."""
    width = len(mean)
    stack = lambda t: _stacked(t.column("vector").combine_chunks(), width)
    qs, vs = stack(queries), stack(rows)
    qids, vids = (t.column("id").to_numpy() for t in (queries, rows))
    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(vs), -1)
    signs = (np.unpackbits(code, axis=1, count=width).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(width))
    length, cosine = (rows.column(n).to_numpy() for n in ("length", "cosine"))
    scale = (length / cosine).astype(np.float32)
    slack = length * np.sqrt(np.maximum(0, 1 - cosine**2)) / cosine * epsilon / math.sqrt(max(1, width - 1))
    v32, sizes = vs.astype(np.float32), np.linalg.norm(vs, axis=1)
    found = [[], [], []]
    for at in range(0, len(qs), 256):
        q = qs[at : at + 256]
        # <q, v> = <q, mean> + length * <q, unit residual>, the last estimated from the signs
        estimate = ((q @ turn).astype(np.float32) @ signs.T) * scale + (q @ mean)[:, None].astype(np.float32)
        q32, norms = q.astype(np.float32), np.linalg.norm(q, axis=1)
        error = (norms[:, None] * slack + 1e-4 * np.abs(estimate) + 1e-6).astype(np.float32)
        own = qids[at : at + 256, None] == vids
        estimate[own] = -np.inf
        # The best estimates, scored exactly, give a k-th best score that the others must reach.
        first = min(FIRST * k, len(vs))
        near = np.argpartition(estimate, len(vs) - first, axis=1)[:, len(vs) - first :]
        best = exact(np.repeat(q, first, axis=0), vs[near.ravel()]).reshape(near.shape)
        best[np.take_along_axis(own, near, axis=1)] = -np.inf
        kth = np.partition(best, first - k, axis=1)[:, first - k] if first >= k else np.full(len(q), -np.inf)
        i, j = np.nonzero((estimate + error >= kth[:, None].astype(np.float32)) & ~own)
        # Single precision settles nearly all of them; what it leaves is scored in double.
        keep = np.empty(len(i), bool)
        for s in range(0, len(i), 65536):
            a, b = i[s : s + 65536], j[s : s + 65536]
            keep[s : s + 65536] = np.einsum("ij,ij->i", q32[a], v32[b]) >= kth[a] - 1e-5 * norms[a] * sizes[b]
        i, j = i[keep], j[keep]
        score = exact(q[i], vs[j])
        order = np.lexsort((vids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        for out, x in zip(found, (qids[at + i[keep]], vids[j[keep]], score[keep])):
            out.append(x)
    cols = [np.concatenate(x) if x else np.zeros(0) for x in found]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def search(
    indexed: Index, queries: DataFrame, *, k: int = 20, epsilon: float = EPSILON, block: int = BLOCK, slice_rows: int = SLICE
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k indexed vectors of the largest inner
    product, nearest first, ties to the smaller id; rows under the query's own id are left out.

    `queries` are rows (id, vector) of the index's width; fewer than k others give all of them,
    none gives no rows. Scores are in double precision.
    """
    mean, turn = indexed.mean, indexed.turn
    slices = math.ceil(indexed.rows.count() / slice_rows) or 1
    blocks = math.ceil(queries.count() / block) or 1
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("id", "vector", deal(blocks).alias("block"), every(slices).alias("slice"))
    held = indexed.rows.select("id", "vector", "code", "length", "cosine", every(blocks).alias("block"), deal(slices).alias("slice"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]).empty_table()
        return _best(left, right, mean, turn, k, epsilon)

    met = (
        asked.groupBy("block", "slice")
        .cogroup(held.groupBy("block", "slice"))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, u.vec_id, list_inner_product(q.v, u.v) AS score
  FROM usable q JOIN usable u ON q.vec_id <> u.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scored QUALIFY rank <= 20
"""
