"""Maximum inner product search with score-aware four-bit codes.

Vectors are cut into pairs of components, and each pair is replaced by one of 16
centres. Centres and codes minimise an anisotropic loss: the part of the residual
parallel to the vector weighs ``eta`` times the rest, as it is that part which
moves the inner products of the queries that matter. Codebooks are fitted on a
bounded sample; every vector is encoded.

A search deals rows and queries to the cells of a grid, a block of rows against a
block of queries each, of bounded size whatever the table. In a cell, a query's
tables (16 entries a pair, two of them joined to a byte) are summed over all
codes, the best ``SHORTLIST`` rows are scored again on the original vectors in
double precision, and the best of those go on to be merged. Where the later half of
a shortlist still gave neighbours (a crowd of vectors whose codes are alike) the
shortlist is doubled, up to the whole block, so no crowd is cut short. No cell is
skipped; recall is measured against brute force in tests.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those without an id or of another length than most
(ties: the longer); an id is one vector, of rows that share it the greatest counts;
equal scores go by the smaller id; further columns are ignored; without queries or
with no other vector the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut

PAIR, CENTRES = 2, 16
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 8192
#: Inner product (of unit vectors) from which errors matter; sets the loss's weight.
THRESHOLD = 0.2
ROUNDS, SWEEPS = 6, 2
#: Rows and queries of a cell, and rows a query scores exactly in each at first.
BLOCK, QUERY_BLOCK, SHORTLIST = 8192, 32_768, 192
#: The query set: ids divisible by this; neighbours of each.
EVERY, NEAREST = 20, 20


@dataclass
class Codebooks:
    centres: np.ndarray  # pairs x 16 x 2
    eta: float

    def pairs(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into pairs of components; an odd last one is filled with zero."""
        if x.shape[1] % PAIR:
            x = np.concatenate([x, np.zeros((len(x), 1), x.dtype)], axis=1)
        return x.reshape(len(x), -1, PAIR)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x pairs) by coordinate descent on the anisotropic loss."""
        parts = self.pairs(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        n, m, _ = parts.shape
        codes = np.empty((n, m), dtype=np.uint8)
        for j in range(m):
            d = parts[:, j, None, :] - self.centres[j]
            codes[:, j] = (d * d).sum(axis=2).argmin(axis=1)
        rows = np.arange(n)
        chosen = parts - self.centres[np.arange(m), codes]
        along = (chosen * unit).sum(axis=(1, 2))
        for _ in range(SWEEPS):
            for j in range(m):
                d = parts[:, j, None, :] - self.centres[j]
                here = np.einsum("nkd,nd->nk", d, unit[:, j])
                rest = along - here[rows, codes[:, j]]
                cost = (d * d).sum(axis=2) + (self.eta - 1) * (rest[:, None] + here) ** 2
                codes[:, j] = cost.argmin(axis=1)
                along = rest + here[rows, codes[:, j]]
        return codes

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Codes of two pairs to a byte."""
        codes = self.encode(x)
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query, the inner products by packed byte (queries x bytes x 256)."""
        t = np.einsum("qmd,mkd->qmk", self.pairs(q), self.centres).astype(np.float32)
        if t.shape[1] % 2:
            t = np.concatenate([t, np.zeros_like(t[:, :1])], axis=1)
        return (t[:, ::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)


def weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How much more the parallel error weighs (never less than the rest)."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def fit(x: np.ndarray, seed: int = 5) -> Codebooks:
    """Codebooks from sample rows: k-means by pairs, then anisotropic rounds."""
    rng = np.random.default_rng(seed)
    books = Codebooks(np.zeros((1, CENTRES, PAIR)), weight(x.shape[1]))
    parts = books.pairs(x)
    n, m, _ = parts.shape
    centres = np.empty((m, CENTRES, PAIR))
    for j in range(m):
        p = parts[:, j]
        c = p[rng.choice(n, CENTRES, replace=n < CENTRES)].copy()
        for _ in range(10):
            own = ((p[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            for k in range(CENTRES):
                if (own == k).any():
                    c[k] = p[own == k].mean(axis=0)
        centres[j] = c
    books.centres = centres
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    size = m * CENTRES * PAIR
    for _ in range(ROUNDS):
        codes = books.encode(x)
        # all centres at once: the normal equations of the quadratic loss
        left, right = np.zeros((size, size)), np.zeros(size)
        at = ((np.arange(m) * CENTRES + codes) * PAIR)[:, :, None] + np.arange(PAIR)
        np.add.at(left, (at.ravel(), at.ravel()), 1.0)
        np.add.at(right, at.ravel(), parts.ravel())
        norm = (unit * parts).sum(axis=(1, 2))
        for s in range(0, n, 1024):
            g = np.zeros((min(1024, n - s), size))
            np.put_along_axis(g, at[s : s + 1024].reshape(len(g), -1), unit[s : s + 1024].reshape(len(g), -1), axis=1)
            left += (books.eta - 1) * g.T @ g
            right += (books.eta - 1) * g.T @ norm[s : s + 1024]
        left += 1e-6 * np.eye(size)
        solved = np.linalg.solve(left, right).reshape(m, CENTRES, PAIR)
        used = np.zeros((m, CENTRES), dtype=bool)
        used[np.arange(m), codes] = True
        books.centres = np.where(used[:, :, None], solved, books.centres)
    return books


def usable(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(id, v)`` of the vectors that take part, one an id, and their common length."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = rows.select(F.col(id_column).alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    )
    return own.groupBy("id").agg(F.max("v").alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def highest(approx: np.ndarray, take: int) -> np.ndarray:
    """The places of the ``take`` highest values, highest first, ties in order of place."""
    if take < len(approx):
        least = np.partition(approx, len(approx) - take)[len(approx) - take]
        above = np.flatnonzero(approx > least)
        found = np.concatenate([above, np.flatnonzero(approx == least)[: take - len(above)]])
    else:
        found = np.arange(len(approx))
    return found[np.argsort(-approx[found], kind="stable")]


def search_cell(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, qids: np.ndarray, q: np.ndarray, books: Codebooks, k: int) -> tuple:
    """Each query's best ``k`` of a block of rows: query ids, row ids, exact scores."""
    order = np.argsort(ids, kind="stable")
    ids, x, columns = ids[order], x[order], codes[order].T.astype(np.intp)
    out: tuple[list, list, list] = ([], [], [])
    for s in range(0, len(q), 64):
        tables = books.tables(q[s : s + 64])
        for t, qid, vector in zip(tables, qids[s : s + 64], q[s : s + 64]):
            approx = t[0][columns[0]]
            for row, c in zip(t[1:], columns[1:]):
                approx += row[c]
            take = SHORTLIST
            while True:
                near = highest(approx, take)
                exact = (x[near] * vector).sum(axis=1)
                exact[ids[near] == qid] = -np.inf
                best = np.lexsort((ids[near], -exact))[:k]
                if take >= len(ids) or best.max(initial=0) < take // 2:
                    break
                take *= 2  # the later half still gave neighbours: its codes are too alike to tell
            best = best[ids[near[best]] != qid]
            out[0].append(np.full(len(best), qid))
            out[1].append(ids[near[best]])
            out[2].append(exact[best])
    empty = np.zeros(0, dtype=np.int64), np.zeros(0)
    return (
        np.concatenate([empty[0], *out[0]]), np.concatenate([empty[0], *out[1]]), np.concatenate([empty[1], *out[2]]),
    )


def nearest(
    rows: DataFrame, every: int = EVERY, k: int = NEAREST, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best ``k`` of each stated query."""
    spark = rows.sparkSession
    schema = T.StructType.fromDDL("query_id long, rank int, vec_id long, score double")
    own = usable(rows, id_column, vector_column).withColumn("dim", F.size("v"))
    lengths = own.groupBy("dim").count().orderBy(F.col("count").desc(), F.col("dim").desc()).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim, n = lengths[0]["dim"], lengths[0]["count"]
    own = own.where(F.col("dim") == dim).select("id", "v")

    share = min(1.0, SAMPLE / n)
    order = F.xxhash64(F.lit("codebooks"), "id")
    taken = own.where(order / F.lit(float(1 << 64)) + 0.5 <= 1.2 * share).orderBy(order, "id").limit(SAMPLE)
    sample = np.asarray([r["v"] for r in taken.select("v").collect()])
    books = spark.sparkContext.broadcast(fit(sample))

    def encode(batches):
        for b in batches:
            x = _matrix(pa.chunked_array([b.column(1)]), dim)
            codes = np.concatenate([books.value.packed(x[s : s + 4096]) for s in range(0, len(x), 4096)]) if len(x) else x
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, packed], names=["id", "v", "code"])

    indexed = cut(own.mapInArrow(encode, "id long, v array<double>, code binary"))
    across = -(-n // BLOCK)
    down = max(1, -(-n // (every * QUERY_BLOCK)))
    cell = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = indexed.withColumn("across", cell(across)).withColumn("down", all_of(down))
    asked = indexed.where(F.col("id") % every == 0).select("id", "v")
    asked = asked.withColumn("down", cell(down)).withColumn("across", all_of(across))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple = ([], [], [])
        if left.num_rows and right.num_rows:
            codes = np.frombuffer(b"".join(left["code"].to_pylist()), dtype=np.uint8).reshape(left.num_rows, -1)
            found = search_cell(
                left["id"].to_numpy(), _matrix(left["v"], dim), codes, right["id"].to_numpy(), _matrix(right["v"], dim), books.value, k
            )
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    best = (
        data.groupBy("across", "down")
        .cogroup(asked.groupBy("across", "down"))
        .applyInArrow(run, "query_id long, vec_id long, score double")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
