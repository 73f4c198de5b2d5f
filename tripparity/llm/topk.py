"""Exact top-k inner-product search by columnar branch and bound.

Vectors are stored in blocks, one column per dimension. A query walks the dimensions a few at a time:
the partial products of all candidates of a block are added up, what the remaining dimensions can
still contribute is bounded by the remaining masses (norms) of query and candidate, candidates that
cannot reach the k-th best score any more are dropped and the columns compacted to the survivors.
Scores are integers and bounds are rounded outwards, so the result, ties included, is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripparity.llm.common import materialize, read_table, ready

TOP = 20
SCALE = 64
QUERY_MODULUS = 20
BLOCK = 8192  # candidates per block
QUERY_BLOCK = 1024
DIMENSIONS = 8  # dimensions per step
_EXACT = float(1 << 52)
_LOW = np.iinfo(np.int64).min


def quantized(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component; null for null vectors and vectors with a null or non-finite component."""
    values = F.transform(embedding, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(False)), F.transform(values, lambda x: F.floor(x * F.lit(float(scale)))))


def _block(group: pd.DataFrame) -> pd.DataFrame:
    """One block as bytes: ids, rows and the component matrix by dimension (shorter vectors: zeros)."""
    width = max((len(v) for v in group["v"]), default=0)
    matrix = np.zeros((width, len(group)), np.int64)
    for i, v in enumerate(group["v"]):
        matrix[:len(v), i] = v
    return pd.DataFrame({"block": [group["block"].iloc[0]], "width": [width],
                         "ids": [group["id"].to_numpy(np.int64).tobytes()],
                         "rows": [group["row"].to_numpy(np.int64).tobytes()], "data": [matrix.tobytes()]})


def _blocks(vectors: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // size))
    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
    return materialize(keyed.groupBy("block").applyInPandas(
        _block, "block long, width int, ids binary, rows binary, data binary"), name), n


def _masses(matrix: np.ndarray, steps: list[int]) -> np.ndarray:
    """Norm of the dimensions from each step on, rounded up; one row per step."""
    squares = np.zeros((len(steps), matrix.shape[1]))
    for i, at in enumerate(steps):
        squares[i] = (matrix[at:].astype(float) ** 2).sum(axis=0)
    return np.sqrt(squares) * (1 + 1e-12)


def search_block(queries: np.ndarray, query_rows: np.ndarray, floors: np.ndarray, data: np.ndarray, rows: np.ndarray,
                 ids: np.ndarray, top: int, dimensions: int = DIMENSIONS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(candidate positions, scores) of each query's best ``top`` in one block; candidates that are
    certainly below the query's floor are left out. Matrices are dimensions x vectors."""
    width = max(len(queries), len(data))
    queries = np.vstack([queries, np.zeros((width - len(queries), queries.shape[1]), np.int64)])
    data = np.vstack([data, np.zeros((width - len(data), data.shape[1]), np.int64)])
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(width, 1)
    if not most < _EXACT:
        return [_plain(queries[:, i], query_rows[i], data, rows, ids, top) for i in range(queries.shape[1])]
    q, d = queries.astype(float), data.astype(float)
    steps = list(range(0, width, dimensions)) + [width]
    mass_q, mass_d = _masses(q, steps), _masses(d, steps)
    first = q[:steps[1]].T @ d[:steps[1]] if width else np.zeros((q.shape[1], d.shape[1]))
    out = []
    for i in range(q.shape[1]):
        alive = np.flatnonzero(rows != query_rows[i])
        partial, columns = first[i, alive], None
        floor = float(floors[i])
        for step in range(1, len(steps)):
            if step > 1:
                lo, hi = steps[step - 1], steps[step]
                columns = d[lo:hi, alive] if columns is None else columns
                partial = partial + q[lo:hi, i] @ columns
                columns = None
            slack = mass_q[step, i] * mass_d[step, alive]
            if len(alive) > top:
                floor = max(floor, np.partition(partial - slack, len(alive) - top)[len(alive) - top])
            keep = partial + slack >= floor - 1e-6 * abs(floor)
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        order = np.lexsort((rows[alive], ids[alive], -partial))[:top]
        out.append((alive[order], partial[order].astype(np.int64)))
    return out


def _plain(query: np.ndarray, query_row: int, data: np.ndarray, rows: np.ndarray, ids: np.ndarray,
           top: int) -> tuple[np.ndarray, np.ndarray]:
    """Components too large for exact doubles: whole-number sums, clamped to the long range."""
    low, high = int(_LOW), int(np.iinfo(np.int64).max)
    exact = query.astype(object) @ data.astype(object) if len(query) else np.zeros(data.shape[1], object)
    scores = [min(max(int(x), low), high) for x in exact]
    best = sorted((i for i in range(len(rows)) if rows[i] != query_row), key=lambda i: (-scores[i], ids[i], rows[i]))[:top]
    return np.array(best, np.int64), np.array([scores[i] for i in best], np.int64)


def _search(pairs: DataFrame, top: int) -> DataFrame:
    """Best ``top`` of every (query block, candidate block) pair."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                ids, rows = np.frombuffer(r.ids, np.int64), np.frombuffer(r.rows, np.int64)
                query_ids, query_rows = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_rows, np.int64)
                data = np.frombuffer(r.data, np.int64).reshape(r.width, len(ids))
                queries = np.frombuffer(r.q_data, np.int64).reshape(r.q_width, len(query_ids))
                floors = np.full(len(query_ids), _LOW) if r.floors is None else np.frombuffer(r.floors, np.int64)
                found = search_block(queries, query_rows, floors, data, rows, ids, top)
                size = [len(at) for at, _ in found]
                at = np.concatenate([a for a, _ in found]).astype(np.int64)
                yield pd.DataFrame({"q_block": r.q_block, "query_row": np.repeat(query_rows, size),
                                    "query_id": np.repeat(query_ids, size), "vec_id": ids[at], "row": rows[at],
                                    "score": np.concatenate([s for _, s in found])})

    return pairs.mapInPandas(run, "q_block long, query_row long, query_id long, vec_id long, row long, score long")


def _floors(group: pd.DataFrame) -> pd.DataFrame:
    query_rows = np.frombuffer(group["q_rows"].iloc[0], np.int64)
    known = dict(zip(group["query_row"], group["floor"]))
    floors = np.array([_LOW if pd.isna(v) else int(v) for v in (known.get(r) for r in query_rows.tolist())], np.int64)
    return pd.DataFrame({"q_block": [group["q_block"].iloc[0]], "floors": [floors.tobytes()]})


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP,
          scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's ``top`` best other rows, ties to the smaller id.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no
    part; an empty vector scores 0; vectors of different lengths multiply over the common
    components; scores beyond 64 bits count as the largest or
    smallest number; repeated rows are rows of their own (a query's own row alone is left out); an
    empty table gives an empty result; other columns are ignored. Queries meet candidates block by
    block; a first pass over one block per query block gives each query a floor for all others.
    """
    ready(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v"),
                          is_query.alias("query")).where("id is not null and v is not null")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    stored, blocks = _blocks(rows.select("row", "id", "v"), block, "topk-blocks")
    asked, _ = _blocks(rows.where("query").select("row", "id", "v"), query_block, "topk-queries")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    pairs = asked.withColumn("block", F.pmod(F.col("q_block"), F.lit(blocks))).withColumn("floors", F.lit(None).cast("binary"))
    seen = _search(pairs.join(stored, "block"), top)
    floors = seen.groupBy("q_block", "query_row").agg(F.min("score").alias("floor"), F.count("*").alias("n")) \
        .select("q_block", "query_row", F.when(F.col("n") >= top, F.col("floor")).alias("floor"))
    floors = asked.select("q_block", "q_rows").join(floors, "q_block", "left").groupBy("q_block") \
        .applyInPandas(_floors, "q_block long, floors binary")
    asked = asked.join(materialize(floors, "topk-floors"), "q_block")
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    best = _search(pairs.join(stored, "block"), top)
    ranked = best.withColumn("rank", F.expr("row_number() over (partition by query_row order by score desc, vec_id, row)"))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Contract query: vec_id divisible by 20 against every other row, the 20 highest scores."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_MODULUS == 0)


OP10_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS query_row, q.vec_id AS query_id, c.r AS r, c.vec_id AS vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.r <> c.r
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id, r) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
