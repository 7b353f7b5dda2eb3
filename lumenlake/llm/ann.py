"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is centred, normalised, rotated by one random orthogonal matrix, and
kept as the signs of its coordinates: d packed bits and two correction scalars
(its distance from the centre, and the inner product of the unit vector with its
own code).  The inner product of a query with a vector is estimated from the bits
and the scalars alone -- the rotated query is quantised to a few bit planes, so
the estimate is a weighted sum of bit counts -- and has an error bound that holds
with high probability for any data, since the rotation is random.  Vectors whose
least possible distance does not exceed the tenth best exact one found are
reranked with exact distances on the original vectors.

A search is the query set against all rows, in blocks: rows and queries are dealt
into blocks of bounded size by a hash, each block of rows meets each block of
queries, gives each query its best ``k`` with exact distances, and the best of
all blocks are ranked.  No vector is left out: what the bounds exclude is decided
on its code.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm import shared

#: Rows that the centre is the mean of, at most (those of the least hash of vec_id).
FIT_ROWS = 20_000
#: Standard deviations of the estimate's error that the bound covers.
SIGMAS = 3.0
#: Bit planes of a quantised query.
PLANES = 6
#: Rows of a block (of the rows: a 64th of all within these limits) and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = (4096, 65_536), 16_384


def rotation(d: int, seed: int = 9) -> np.ndarray:
    """A random orthogonal d x d matrix, the same for a seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


class Index:
    """Centre and rotation; codes of vectors, and estimates from them."""

    def __init__(self, centre: np.ndarray, seed: int = 9):
        self.centre = centre.astype(np.float64)
        self.turn = rotation(len(centre), seed)
        self.words = -(-len(centre) // 64)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), self.words * 64), np.uint8)
        wide[:, : bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, distance from the centre, inner product of the unit vector with its code."""
        y = (x - self.centre) @ self.turn
        norm = np.sqrt((y * y).sum(1))
        y /= np.where(norm > 0, norm, 1)[:, None]
        own = np.abs(y).sum(1) / math.sqrt(x.shape[1])
        return self._pack(y > 0), norm, np.where(norm > 0, own, 1.0)

    def bounds(self, q: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances of a query to coded vectors, and their lower bounds."""
        d = len(q)
        y = (q - self.centre) @ self.turn
        far = math.sqrt(float(y @ y))
        if far == 0:
            return norm * norm, norm * norm
        y = y / far
        low, step = float(y.min()), max((float(y.max()) - float(y.min())) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((y - low) / step).astype(np.int64)
        # <code, y> with code = (2 bit - 1) / sqrt(d) and y about low + step * level
        total = np.zeros(len(codes), np.int64)
        for p in range(PLANES):
            plane = self._pack(((level >> p) & 1).astype(np.uint8)[None, :])[0]
            total += np.bitwise_count(codes & plane).sum(1, dtype=np.int64) << p
        ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
        product = (2 * (low * ones + step * total) - (low * d + step * float(level.sum()))) / math.sqrt(d)
        inner = product / own
        error = SIGMAS * np.sqrt(np.maximum(0, 1 - own * own)) / own / math.sqrt(max(1, d - 1)) + 0.5 * step * math.sqrt(d) / own
        square = norm * norm + far * far
        return square - 2 * norm * far * inner, square - 2 * norm * far * (inner + error)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        step = x[:, j].astype(np.float64) - float(q[j])
        total += step * step
    return np.sqrt(total)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part: not null, not zero, no null or non-finite component, of the most common length; vec_id not null."""
    finite = F.forall("embedding", lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda v: v != 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == F.lit(lengths[0]["d"] if lengths else -1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``vectors``, ``queries`` (vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest vectors of each query.

    score is the exact Euclidean distance; ranks go by (score, vec_id).  Rows of
    the query's own vec_id are no candidates.  Unusable vectors (``usable``) take
    no part on either side.  A vec_id that is asked twice is asked once, with its
    least vector; repeated candidates each count.  With fewer than k candidates
    all are returned; empty tables give an empty one.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    n = rows.count()
    schema = T.StructType([T.StructField("query_id", vectors.schema["vec_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("score", T.DoubleType())])
    if n == 0:
        return spark.createDataFrame([], schema)
    sample = rows.select("embedding", F.xxhash64("vec_id").alias("draw")).orderBy("draw").limit(FIT_ROWS).select("embedding").collect()
    centre = np.array([r["embedding"] for r in sample], dtype=np.float64).mean(0)
    d = len(centre)
    asked = queries.where(F.size("embedding") == d)
    asked = usable(asked).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_asked = asked.count()
    index = spark.sparkContext.broadcast(Index(centre))
    per_block = min(max(n // 64, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    row_blocks, query_blocks = -(-n // per_block), max(1, -(-n_asked // BLOCK_QUERIES))

    def encode(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
            codes, norm, own = index.value.encode(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(own)], names=["vec_id", "embedding", "code", "norm", "own"])

    kind = rows.schema["embedding"].dataType
    coded = shared.map_arrow(rows, encode, T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("embedding", kind), T.StructField("code", T.BinaryType()), T.StructField("norm", T.DoubleType()), T.StructField("own", T.DoubleType())]))

    def dealt(frame, own, blocks, other, others):
        # copies of one vector differ in nothing but their id, which is what deals them
        place = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias(own)
        return frame.select("*", place, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = dealt(coded, "row_block", row_blocks, "query_block", query_blocks)
    right = dealt(asked, "query_block", query_blocks, "row_block", row_blocks)

    def meet(members: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if members.num_rows and asking.num_rows:
            matrix = [np.asarray(t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, d) for t in (members, asking)]
            ids, names = members["vec_id"].to_numpy(), asking["vec_id"].to_numpy()
            norm, own = members["norm"].to_numpy(), members["own"].to_numpy()
            codes = np.frombuffer(b"".join(members["code"].to_pylist()), np.uint64).reshape(len(ids), -1)
            for name, q in zip(names, matrix[1].astype(np.float64), strict=True):
                guess, least = index.value.bounds(q, codes, norm, own)
                mine = ids == name
                guess[mine] = least[mine] = np.inf
                few = min(k, len(ids) - int(mine.sum()))
                if few <= 0:
                    continue
                first = np.argpartition(guess, few - 1)[:few]
                reach = exact(q, matrix[0][first]).max()
                close = np.flatnonzero(least <= reach * reach * (1 + 1e-9) + 1e-12)
                close = np.union1d(close, first)
                score = exact(q, matrix[0][close])
                best = np.lexsort((ids[close], score))[:k]
                out.append((np.full(len(best), name), ids[close][best], score[best]))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    key = ("row_block", "query_block")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of ``op9_nearest_neighbours``: brute force.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p) WHERE rank <= 10
"""
