"""Exact nearest neighbours by cosine distance, mean vectors of sessions, and vectors as blobs."""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine_distance
from ..scratch import staged


def vector_literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(rows: DataFrame, query: Column, limit: int, order: tuple[str, ...], column: str = "embedding", distance: str = "distance") -> DataFrame:
    """The rows nearest to the query; rows without a vector, with a zero one or one of another length are left out."""
    found = rows.withColumn(distance, cosine_distance(F.col(column), query)).where(F.col(distance).isNotNull())
    return found.drop(column).orderBy(distance, *order).limit(limit)


#: Bytes (as doubles) of a block of queries, which a task holds, and of a block of rows, which passes by it.
QUERY_BYTES, ROW_BYTES = 16 << 20, 4 << 20
#: Distances that are worked out at a time, and more than two ways of adding up the same distance differ by.
MET_AT_ONCE, ROUNDING = 1 << 21, 1e-12


def nearest_to_each(
    rows: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", column: str = "embedding", query_bytes: int = QUERY_BYTES, row_bytes: int = ROW_BYTES
) -> DataFrame:
    """query, the key and distance of the `limit` rows nearest to each query (columns key and column, as in rows), itself left
    out; ties by key. Vectors that `nearest` leaves out are left out, and those of different lengths don't meet.

    Queries and rows are both written down as blocks, and every two splits of what was written meet in one task, which reads them
    there: no vector is shuffled, however many blocks it meets. The task takes one block of queries after another and lets all
    rows of its split pass, keeping the best for each query. So what is shuffled are queries times splits of rows times limit."""
    there = staged(_blocks(rows, key, column, row_bytes), "rows", compression="none")  # so a split is no larger when it is read
    alike = queries is rows and query_bytes == row_bytes
    asked = there if alike else staged(_blocks(queries, key, column, query_bytes), "queries", compression="none")
    asked = asked.withColumnsRenamed({"keys": "asked_keys", "units": "asked_units"})
    met = asked.join(there.drop("block").hint("shuffle_replicate_nl"), "n")
    kind = rows.schema[key].dataType.simpleString()
    found = met.select("n", "block", "asked_keys", "asked_units", "keys", "units").mapInArrow(
        _best_of_blocks(limit), f"query {kind}, key {kind}, distance double"
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= limit).select("query", F.col("key").alias(key), "distance")


def _blocks(rows: DataFrame, key: str, column: str, most: int) -> DataFrame:
    """The usable vectors by blocks of about `most` bytes: n (their length), block (its number), keys in order, and units
    (their directions, as doubles)."""

    def blocks(batches):
        held, kind, number = {}, None, TaskContext.get().partitionId() << 32

        def closed(n):
            nonlocal number
            found, number = sorted(held.pop(n), key=lambda x: _placed(x[0])), number + 1
            values = [n], [number], [[k for k, _ in found]], [b"".join(u for _, u in found)]
            kinds = pa.int32(), pa.int64(), pa.list_(kind), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["n", "block", "keys", "units"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, x in zip(batch.column(0).to_pylist(), map(_unit, batch.column(1).to_pylist())):
                if x is not None:
                    own = held.setdefault(len(x), [])
                    own.append((k, x.tobytes()))
                    if len(own) * len(x) * 8 >= most:
                        yield closed(len(x))
        for n in list(held):
            yield closed(n)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, column).where(F.col(column).isNotNull()).mapInArrow(blocks, f"n int, block long, keys array<{kind}>, units binary")


def _placed(key) -> tuple:
    """Orders keys with null first, as Spark does."""
    return key is not None, key


def _unit(vector) -> np.ndarray | None:
    """In double precision; null for a vector without a length."""
    if vector is None or any(x is None for x in vector):
        return None
    x = np.array(vector, "f8")
    norm = np.linalg.norm(x)
    return x / norm if norm > 0 and np.isfinite(norm) else None


def _best_of_blocks(limit: int):
    """Pairs of blocks, those of one block of queries one after another, to the best rows of each query."""

    def run(batches):
        block, asked, matrix, near, kind = None, [], None, [], None

        def closed():
            out = [(k, other, d) for k, best in zip(asked, near) for d, other in best]
            columns = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, kind, pa.float64()))], ["query", "key", "distance"])

        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for at, (n, own) in enumerate(zip(batch.column("n").to_pylist(), batch.column("block").to_pylist())):
                vectors = lambda name: np.frombuffer(batch.column(name)[at].as_buffer()).reshape(-1, n)  # noqa: E731, B023
                if own != block:
                    if block is not None:
                        yield closed()
                    block, asked, matrix = own, batch.column("asked_keys")[at].as_py(), vectors("asked_units").copy()
                    near = [[] for _ in asked]
                keys, rows = batch.column("keys")[at].as_py(), vectors("units")
                step = max(1, MET_AT_ONCE // len(asked))
                for k in range(0, len(keys), step):
                    _meet(matrix, asked, near, rows[k : k + step], keys[k : k + step], limit)
        if block is not None:
            yield closed()

    return run


def _meet(queries: np.ndarray, asked: list, near: list, rows: np.ndarray, keys: list, limit: int) -> None:
    """Let some rows, in the order of their keys, pass the queries: near has the best (distance, key) of each so far. A product of
    matrices proposes; a distance is then added up in one way wherever the two stand, so equal vectors are equally far."""
    distances = 1 - queries @ rows.T
    own = {}
    for r, key in enumerate(keys):
        own.setdefault(key, []).append(r)
    for q, key in enumerate(asked):
        if key in own:
            distances[q, own[key]] = np.inf
    edges = np.array([best[-1][0] if len(best) == limit else np.finfo("f8").max for best in near]) + ROUNDING
    many = np.flatnonzero((distances <= edges[:, None]).sum(1) > limit)
    if len(many):
        edges[many] = np.minimum(edges[many], np.partition(distances[many], limit - 1, axis=1)[:, limit - 1] + ROUNDING)
    q, r = np.nonzero(distances <= edges[:, None])
    step = max(1, MET_AT_ONCE // queries.shape[1])
    slices = [slice(k, k + step) for k in range(0, len(q), step)]
    exact = np.concatenate([np.zeros(0), *[1 - (rows[r[x]] * queries[q[x]]).sum(1) for x in slices]])
    order = np.lexsort((r, exact, q))
    found, starts, counts = np.unique(q, return_index=True, return_counts=True)
    for k, start, count in zip(found.tolist(), starts.tolist(), counts.tolist()):
        new = [(float(exact[x]), keys[r[x]]) for x in order[start : start + min(limit, count)]]
        near[k] = sorted([*near[k], *new], key=lambda x: (x[0], *_placed(x[1])))[:limit]


def to_blob(vector: Column) -> Column:
    """The vector as 32-bit little-endian floats, as stores keep it."""

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.array(x, "<f4").tobytes() for x in column.to_pylist()], pa.binary())

    return encode(vector)


def from_blob(blob: Column) -> Column:
    """A blob's floats; null where its length isn't a multiple of four."""

    @F.arrow_udf("array<float>")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist() for x in column.to_pylist()], pa.list_(pa.float32()))

    return decode(blob)


def vector_sums(rows: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key and sums: for each place how many vectors reach it (n) and the sum of their numbers there (x), in double precision.
    Partial sums are combined before the shuffle, so a session of any length needs no more than its vector's width."""
    places = rows.where(F.col(column).isNotNull()).select(key, F.posexplode(column).alias("place", "x"))
    found = places.groupBy(key, "place").agg(F.count("x").alias("n"), F.sum(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "n", "x")))
    return found.groupBy(key).agg(F.transform(ordered, lambda p: F.struct(p["n"].alias("n"), p["x"].alias("x"))).alias("sums"))


def added_sums(a: Column, b: Column) -> Column:
    """The sums of what two disjoint sets of vectors have; a null is an empty set."""

    def add(x: Column, y: Column, name: str) -> Column:
        return F.coalesce(x[name], F.lit(0)) + F.coalesce(y[name], F.lit(0))

    both = F.zip_with(a, b, lambda x, y: F.struct(add(x, y, "n").alias("n"), add(x, y, "x").alias("x")))
    return F.coalesce(both, a, b)


def mean_of_sums(sums: Column) -> Column:
    """The mean as floats; places that no vector reaches are null."""
    return F.transform(sums, lambda p: F.when(p["n"] > 0, p["x"] / p["n"]).cast("float"))


def mean_vectors(rows: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """key and the mean of its vectors, place by place in double precision, given as floats."""
    return vector_sums(rows, key, column).select(key, mean_of_sums(F.col("sums")).alias(column))


def similar(summaries: DataFrame, key: str, target, limit: int, column: str = "summary_embedding") -> DataFrame:
    """The keys whose vectors are nearest to the target's own, itself left out. Nothing where the target has no vector."""
    own = summaries.where((F.col(key) == target) & F.col(column).isNotNull()).select(column).first()
    if own is None:
        return summaries.select(key).withColumn("distance", F.lit(None).cast("double")).limit(0)
    others = summaries.where(F.col(key) != target).select(key, column)
    return nearest(others, vector_literal(own[column]), limit, (key,), column)
