"""Nearest neighbours of many queries against brute force."""

import random

import numpy as np
import pytest

from colloquy.operators import vectors

ROW = "vec_id string, embedding array<float>, distance string"


def plain(rows, queries, limit):
    def unit(v):
        if v is None or any(x is None for x in v) or not np.isfinite(v).all() or not np.any(v):
            return None
        x = np.array(v, "f4").astype("f8")
        return x / np.linalg.norm(x)

    out = set()
    usable = [(k, unit(v)) for k, v in rows if unit(v) is not None]
    for q, v in queries:
        if unit(v) is not None:
            found = sorted((round(float(1 - unit(v) @ x), 9), k) for k, x in usable if k != q and len(x) == len(v))
            out |= {(q, k, round(d, 6)) for d, k in found[:limit]}
    return out


@pytest.mark.parametrize("query_bytes,row_bytes", [(1 << 24, 1 << 28), (600, 2000), (40, 200)])
def test_blocks_of_any_size_give_the_nearest(spark, query_bytes, row_bytes):
    rng = random.Random(4)
    rows = [(f"k{k}", [rng.gauss(0, 1) for _ in range(4)]) for k in range(150)] + [(f"s{k}", [rng.gauss(0, 1) for _ in range(3)]) for k in range(20)]
    rows += [("null", None), ("hole", [1.0, None, 2.0, 3.0]), ("zero", [0.0] * 4), ("nan", [float("nan")] * 4), ("empty", [])]
    df = spark.createDataFrame([(k, v, "odd") for k, v in rows], ROW).repartition(5)
    got = vectors.nearest_to_each(df, df, 3, query_bytes=query_bytes, row_bytes=row_bytes)
    assert got.columns == ["query", "vec_id", "distance"]
    found = [(r["query"], r.vec_id, round(r.distance, 6)) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, rows, 3)


def test_ties_go_by_key_and_nothing_has_no_neighbours(spark):
    rows = [(f"k{k:02}", [1.0, 0.0]) for k in range(40)]
    df = spark.createDataFrame([(k, v, "") for k, v in rows], ROW).repartition(3)
    got = {(r["query"], r.vec_id) for r in vectors.nearest_to_each(df, df.where("vec_id in ('k00', 'k30')"), 2, query_bytes=16, row_bytes=100).collect()}
    assert got == {("k00", "k01"), ("k00", "k02"), ("k30", "k00"), ("k30", "k01")}
    assert vectors.nearest_to_each(df, df.where("false"), 2).count() == 0 and vectors.nearest_to_each(df.where("false"), df, 2).count() == 0


def test_no_vector_is_shuffled(spark):
    """However many blocks there are: every two meet where they were written."""
    rng = random.Random(6)
    df = spark.createDataFrame([(f"k{k}", [rng.gauss(0, 1) for _ in range(4)], "") for k in range(60)], ROW).repartition(3)
    got = vectors.nearest_to_each(df, df, 2, query_bytes=64, row_bytes=64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert "CartesianProduct" in plan and len(shuffles) == 1 and "hashpartitioning(query" in shuffles[0]
    assert got.count() == 120


def test_copies_are_equally_far_wherever_they_stand(spark):
    """Ties go by key, also where a product of matrices would round copies differently at its edges."""
    rng = random.Random(7)
    same, query = ([rng.gauss(0, 1) for _ in range(37)] for _ in range(2))
    df = spark.createDataFrame([(f"k{k:03}", same, "") for k in range(203)] + [("q", query, "")], ROW).repartition(3)
    for size in (300, 7000, 1 << 20):
        got = vectors.nearest_to_each(df, df.where("vec_id = 'q'"), 5, query_bytes=size, row_bytes=size).collect()
        assert sorted(r.vec_id for r in got) == [f"k{k:03}" for k in range(5)] and len({r.distance for r in got}) == 1


def test_sums_of_increments_are_the_sums_of_all(spark):
    rng = random.Random(9)
    rows = [(f"s{rng.randrange(5)}", [rng.gauss(0, 1) for _ in range(3)], k % 3) for k in range(60)] + [("odd", None, 0), ("hole", [1.0, None, 3.0], 1)]
    df = spark.createDataFrame(rows, "key string, embedding array<float>, run int")
    kept = spark.createDataFrame([], "key string, sums array<struct<n: bigint, x: double>>")
    for run in range(3):
        more = vectors.vector_sums(df.where(f"run = {run}"), "key").withColumnRenamed("sums", "more")
        kept = kept.join(more, "key", "full_outer").select("key", vectors.added_sums(kept["sums"], more["more"]).alias("sums"))
    got = {r.key: r.mean for r in kept.select("key", vectors.mean_of_sums(kept["sums"]).alias("mean")).collect()}
    assert got.pop("hole") == [1.0, None, 3.0] and "odd" not in got
    assert got == {k: pytest.approx(np.mean([np.array(v, "f4") for key, v, _ in rows if key == k], axis=0, dtype="f8").tolist(), rel=1e-6) for k in got}
    assert {r.key: r.embedding for r in vectors.mean_vectors(df, "key").collect() if r.key != "hole"} == {k: pytest.approx(v, rel=1e-6) for k, v in got.items()}
