"""Nearest vectors, exact or by hashing, and the context built from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.functions.text import col
from gradeframe.session import ensure_checkpoint_dir

BLOCK_QUERIES = 2_000
BLOCK_VECTORS = 20_000
#: Blocks of a side up to which small blocks are kept, and rows that a block then grows to before there are more.
GRID, BLOCK_ROWS = 16, 50_000
#: Queries and vectors whose scores are held at once, and candidates for each query up to which they are sorted.
ROWS, TILE, MANY = 256, 4096, 16
#: Rows of buckets that a task of the approximate search takes, about.
BUCKET_ROWS = 50_000
#: Partitions that buckets are dealt to at most.
PARTITIONS = 1000
#: Queries up to which they are sent to the vectors.
FEW_QUERIES = 2_000


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms > 0, norms, 1.0)


def _units(m: np.ndarray) -> np.ndarray:
    """Unit rows as doubles, made TILE rows at a time."""
    out = np.empty(m.shape)
    for j in range(0, len(m), TILE):
        out[j : j + TILE] = _unit(m[j : j + TILE].astype(float))
    return out


class _Best:
    """The ``k`` best vectors met so far by each query; equal scores go to the smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray | None, k: int):
        self.queries, self.own, self.k = _units(queries), own, k
        self.scores, self.ids = np.full((len(queries), k), -np.inf), None

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids) or not len(self.queries):
            return
        if self.ids is None:
            self.scores, self.ids = np.full((len(self.queries), self.k), -np.inf), np.zeros((len(self.queries), self.k), ids.dtype)
        elif self.ids.dtype != ids.dtype:
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        for j in range(0, len(ids), TILE):
            tile = _unit(vectors[order[j : j + TILE]].astype(float))
            for i in range(0, len(self.queries), ROWS):
                self._tile(i, ids[j : j + TILE], self.queries[i : i + ROWS] @ tile.T)

    def _tile(self, start: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in the scores of some queries with vectors in the order of their ids."""
        n = len(scores)
        if self.own is not None:
            own = self.own[start : start + n]
            low, high = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
            for row in np.flatnonzero(high > low):
                scores[row, low[row] : high[row]] = -np.inf
        # Scores count by nine decimals; what is further below the last one kept cannot enter.
        open_ = scores >= (self.scores[start : start + n, -1] - 1e-9)[:, None]
        if np.count_nonzero(open_) > MANY * n:
            scores, keep = np.where(np.isnan(scores), -np.inf, np.round(scores, 9)), min(self.k, len(ids))
            row, at = np.repeat(np.arange(n), keep), np.zeros((n, keep), np.int64)
            value, rows = np.zeros((n, keep)), np.arange(n)
            for j in range(keep):
                # The first of equal maxima is the smallest id.
                at[:, j] = scores.argmax(1)
                value[:, j] = scores[rows, at[:, j]]
                scores[rows, at[:, j]] = -np.inf
            at, value = at.ravel(), value.ravel()
        else:
            row, at = np.divmod(np.flatnonzero(open_), len(ids))
            value = np.round(scores[row, at], 9)
        use = np.isfinite(value)
        row, at, value = row[use], at[use], value[use]
        if not len(row):
            return
        met = np.unique(row)
        row = np.concatenate([np.repeat(met, self.k), row])
        value = np.concatenate([self.scores[start + met].ravel(), value])
        names = np.concatenate([self.ids[start + met].ravel(), ids[at]])
        order = np.lexsort((names, -value, row))
        row, value, names = row[order], value[order], names[order]
        first = np.searchsorted(row, met)[:, None] + np.arange(self.k)
        self.scores[start + met], self.ids[start + met] = value[first], names[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the vectors kept, queries by place."""
        if self.ids is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, at = np.nonzero(np.isfinite(self.scores))
        return query, self.ids[query, at], self.scores[query, at]


def _ids(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    found = values.to_numpy(zero_copy_only=False) if isinstance(values, pa.Array) else values.to_numpy()
    return found.astype(str) if found.dtype == object else found


def _matrix(rows: pa.Table, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the vectors of some rows, in the vectors' own type."""
    flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _ids(rows.column(name)), flat.reshape(rows.num_rows, width)


def _usable(df: DataFrame, key: str, vector: str) -> Column:
    holes = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(holes, F.lit(True))


def _few(asked: list, vectors: DataFrame, k: int, schema: T.StructType, exclude_self: bool) -> DataFrame:
    """A bounded block of queries goes to the vectors: no vector is moved, each task sends its winners."""
    width = len(asked[0]["embedding"])
    names = [r["query_id"] for r in asked]
    own = _ids(pa.array(names)) if exclude_self else None
    matrix = np.array([r["embedding"] for r in asked], float).reshape(len(asked), width)
    shared = vectors.sparkSession.sparkContext.broadcast((names, own, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, matrix = shared.value
        best = _Best(matrix, own, k)
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), width))
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            best.meet(_ids(batch.column("vec_id")), flat.reshape(batch.num_rows, width).astype(float))
        query, ids, scores = best.rows()
        told = batch_schema.field("query_id").type, batch_schema.field("vec_id").type
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in query], told[0]), pa.array(ids.tolist(), told[1]), pa.array(scores)], schema=batch_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    batch_schema = to_arrow_schema(schema)
    return vectors.mapInArrow(run, schema)


def _many(queries: DataFrame, vectors: DataFrame, k: int, schema: T.StructType, exclude_self: bool, block_queries: int, block_vectors: int) -> DataFrame:
    """Blocks of queries meet blocks of vectors; each pair of blocks is one task.

    A row is copied once for every block of the other side, so blocks grow with
    the table before there are more than GRID of them.
    """
    n_q, n_v = (max(1, min(GRID, -(-n // size)), -(-n // max(size, BLOCK_ROWS))) for n, size in ((queries.count(), block_queries), (vectors.count(), block_vectors)))
    every_q, every_v = F.sequence(F.lit(0), F.lit(n_q - 1)), F.sequence(F.lit(0), F.lit(n_v - 1))
    q = queries.select("*", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("_qb"), F.explode(every_v).alias("_vb"))
    v = vectors.select(
        F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"),
        F.explode(every_q).alias("_qb"), F.pmod(F.xxhash64("vec_id"), F.lit(n_v)).cast("int").alias("_vb"),
    )

    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [out_schema.empty_table()]
        widths = [pc.list_value_length(x.column("embedding")) for x in (left, right)]
        for width in sorted(set(pc.unique(widths[0]).to_pylist()) & set(pc.unique(widths[1]).to_pylist())):
            (own, mine), (ids, theirs) = (_matrix(x.filter(pc.equal(n, width)), name, width) for x, n, name in zip((left, right), widths, ("query_id", "vec_id")))
            found = _Best(mine, own if exclude_self else None, k)
            found.meet(ids, theirs)
            query, ids, scores = found.rows()
            columns = (own[query], ids, scores)
            made.append(pa.Table.from_arrays([pa.array(x.tolist(), f.type) for x, f in zip(columns, out_schema)], schema=out_schema))
        return pa.concat_tables(made)

    tasks = min(n_q * n_v, GRID * GRID)
    q, v = (x.repartition(tasks, "_qb", "_vb") for x in (q, v))
    return q.groupBy("_qb", "_vb").cogroup(v.groupBy("_qb", "_vb")).applyInArrow(best, schema)


def _sides(queries: DataFrame, vectors: DataFrame, query_id: str, vector_id: str, embedding: str) -> tuple[DataFrame, DataFrame, T.StructType]:
    q = queries.where(_usable(queries, query_id, embedding)).select(F.col(query_id).alias("query_id"), F.col(embedding).alias("embedding"))
    v = vectors.where(_usable(vectors, vector_id, embedding)).select(F.col(vector_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    score = T.StructField("score", T.DoubleType())
    return q, v, T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), T.StructField("vec_id", v.schema["vec_id"].dataType), score])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_similar(
    queries: DataFrame, vectors: DataFrame, k: int = 3, query_id: str = "query_id", vector_id: str = "vec_id",
    embedding: str = "embedding", exclude_self: bool = False,
    block_queries: int = BLOCK_QUERIES, block_vectors: int = BLOCK_VECTORS, few_queries: int = FEW_QUERIES,
) -> DataFrame:
    """The ``k`` vectors with the largest cosine for every query (query_id, vec_id, score, rank).

    Exact search compares every query with every vector. Up to ``few_queries``
    queries are sent to all tasks, which keep the best of their vectors for each
    query, so vectors stay where they are. More queries and the vectors are cut
    into blocks by a hash of their ids and each pair of blocks is one task.
    Either way only winners are shuffled to the final top k. For very many
    queries ``top_k_approximate`` compares far fewer pairs.

    Vectors that are NULL, hold NULL or NaN, or have another length than the
    query take no part, nor do NULL ids. Runs at once to count the queries.
    """
    q, v, schema = _sides(queries, vectors, query_id, vector_id, embedding)
    asked = q.limit(few_queries + 1).collect() if few_queries else []
    lengths = {len(r["embedding"]) for r in asked}
    if few_queries and len(asked) <= few_queries and len(lengths) <= 1:
        found = _few(asked, v, k, schema, exclude_self) if asked else q.sparkSession.createDataFrame([], schema)
    else:
        found = _many(q, v, k, schema, exclude_self, block_queries, block_vectors)
    return _ranked(found, k)


def top_k_approximate(
    queries: DataFrame, vectors: DataFrame, k: int = 3, query_id: str = "query_id", vector_id: str = "vec_id",
    embedding: str = "embedding", exclude_self: bool = False, tables: int = 32, projections: int = 5, bucket: float = 0.5, seed: int = 42,
) -> DataFrame:
    """J10 for many queries: as ``top_k_similar``, but only vectors that share a bucket with the query are compared.

    ``BucketedRandomProjectionLSH`` hashes unit vectors; ``projections`` of its
    buckets together are the key of one of ``tables`` tables. Pairs that meet in
    any table are scored exactly, so scores are right but a neighbour that meets
    the query nowhere is missed: more tables or wider buckets find more and
    compare more. ``recall`` measures what is found.

    Vectors go to their buckets, once for each table, and a bucket sends only a
    query's ``k`` best, so pairs are never rows. Runs at once to hash and count.
    """
    q, v, schema = _sides(queries, vectors, query_id, vector_id, embedding)

    def with_unit(df: DataFrame) -> DataFrame:
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        return df.withColumn("_unit", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))))

    q, v = with_unit(q), with_unit(v)
    model = BucketedRandomProjectionLSH(inputCol="_unit", outputCol="_hashes", bucketLength=bucket, numHashTables=tables * projections, seed=seed).fit(v)
    ensure_checkpoint_dir(q.sparkSession)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        # One bucket number per projection, as text.
        numbers = F.regexp_extract_all(F.col("_hashes").cast("string"), F.lit("-?[0-9][0-9.E]*"), F.lit(0))
        rows = model.transform(df).select(name, "embedding", numbers.alias("_n"))
        keys = F.array(*[F.xxhash64(F.lit(t), F.slice("_n", t * projections + 1, projections)) for t in range(tables)])
        return rows.select(F.col(name).alias("id"), "embedding", keys.alias("_keys")).checkpoint()

    q, v = keyed(q, "query_id"), keyed(v, "vec_id")
    # Small buckets share a task; each side of a large one is dealt to several.
    parts = max(1, -(-tables * (q.count() + v.count()) // BUCKET_ROWS))

    def large(df: DataFrame, out: str) -> DataFrame:
        held = df.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.count("*").alias("n"))
        return held.where(F.col("n") > BUCKET_ROWS).select("_key", F.ceil(F.col("n") / BUCKET_ROWS).alias(out))

    deals = large(q, "_nq").join(large(v, "_nv"), "_key", "full").checkpoint()
    one = F.lit(1).cast("long")

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        rows = df.select("id", "embedding", F.explode("_keys").alias("_key")).join(deals, "_key", "left")
        part = F.when(F.col("_nq").isNull() & F.col("_nv").isNull(), F.pmod("_key", F.lit(parts))).otherwise(F.col("_key"))
        own = F.pmod(F.xxhash64("id"), F.coalesce(mine, one)).alias(f"{mine}_at")
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, one) - 1)).alias(f"{other}_at")
        return rows.select("id", "embedding", "_key", part.alias("_part"), own, copies)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("_key"), right.sort_values("_key")
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        keys = np.intersect1d(left["_key"], right["_key"])
        if len(keys):
            mine, theirs = (np.stack(x["embedding"].to_list()).astype(float) for x in (left, right))
            asked, known = left["id"].to_numpy(), right["id"].to_numpy()
            ends = [np.searchsorted(x["_key"].to_numpy(), keys, side) for x in (left, right) for side in ("left", "right")]
            for a, b, c, d in zip(*(e.tolist() for e in ends)):
                if exclude_self and b - a == 1 and d - c == 1 and asked[a] == known[c]:
                    continue
                found = _Best(mine[a:b], asked[a:b] if exclude_self else None, k)
                found.meet(known[c:d], theirs[c:d])
                query, ids, scores = found.rows()
                out.append((asked[a:b][query], ids, scores))
        made = [np.concatenate(x) for x in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(schema.names, made)))

    groups = ["_part", "_nq_at", "_nv_at"]
    sides = [x.repartition(min(parts, PARTITIONS), *groups).groupBy(*groups) for x in (dealt(q, "_nq", "_nv"), dealt(v, "_nv", "_nq"))]
    # A query's best of all its buckets are among the best of each; a pair found in several counts once.
    found = sides[0].cogroup(sides[1]).applyInPandas(best, schema)
    return _ranked(found.repartition("query_id").dropDuplicates(["query_id", "vec_id"]), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of exact neighbours among the found ones (recall, n): one row."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("_hit")).distinct()
    return exact.join(hit, ["query_id", "vec_id"], "left").agg((F.count("_hit") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("n"))


def retrieved_context(
    hits: DataFrame, texts: DataFrame, key: str = "vec_id", text: str = "text", separator: str = "\n\n---\n\n", limit: int = 3000
) -> DataFrame:
    """Texts of the hits of each query, best first, joined and cut to ``limit`` characters."""
    rows = hits.join(texts.select(key, text), key)
    # At most k hits per query come out of top_k_similar.
    ordered = F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), col(text).alias("t"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["t"]), separator)
    return rows.groupBy("query_id").agg(F.left(joined, F.lit(limit)).alias("context"))
