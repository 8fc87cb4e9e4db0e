import random

import pytest

import corpus_pipeline
from colloquy.llm import queries

from .conftest import DOC, sentences


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows, labels = random.Random(9), [], []
    passage = sentences(rng, 8)
    for k in range(240):
        toxic = k % 6 == 0
        text = sentences(rng, 10) + (" You idiot scum moron." if toxic else "") + (" " + passage if k % 20 == 7 else "")
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, int(toxic)))
    for k in range(20):
        rows.append((1000 + k, rows[k * 6 + 1][1] + " Extra end.", "en", "s1", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (None, "No id here.", "en", "s0", 11)]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, passage


def test_each_stage_takes_effect(spark, corpus):
    where, passage = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        seen[name] = docs.collect()
        if name != "pieces":
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[name], docs.schema)
    ids = {name: [r.doc_id for r in rows] for name, rows in seen.items()}
    clean = {k for k in range(240) if k % 6}
    assert set(ids["toxicity"]) == clean | {1000 + k for k in range(20)} | {2000, 2001, None}
    assert set(ids["near_duplicates"]) == clean | {2000, 2001, None} and len(ids["near_duplicates"]) == len(clean) + 3
    kept = {r.doc_id: r.text for r in seen["repeats"]}
    assert sum(passage in (t or "") for t in kept.values()) == 1 and len(kept) == len(clean) + 3
    assert set(ids["mixing"]) <= set(kept) and len(ids["mixing"]) > len(kept)
    assert len(ids["pieces"]) == len(ids["mixing"])
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, where).collect()) == sorted(map(str, ids["pieces"]))


def test_every_operator_is_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(queries.oracle_sql()) <= set(names)


def test_extra_columns_of_any_name_come_through(spark, corpus, tmp_path):
    from pyspark.sql import functions as F

    where, _ = corpus
    own = spark.read.parquet(f"{where}/documents.parquet")
    names = [
        "tox_score", "tox_density", "kept_id", "class_id", "node", "component", "removed", "n_removed", "whole", "below", "plan_source", "size", "target",
        "repeats", "taken", "draw", "id", "first", "h1", "a.b"
    ]
    clash = own.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    clash = clash.withColumn("map", F.create_map(F.lit("k"), F.col("doc_id")))
    docs, plain = clash, own
    for name, stage in corpus_pipeline.STAGES:
        docs, plain = stage(spark, docs, where), stage(spark, plain, where)
        if name == "pieces":
            assert docs.count() == plain.count()
            break
        assert docs.columns == clash.columns
        rows = docs.collect()
        assert all(r[n] == f"{n}:{'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
        own_rows = plain.collect()
        assert sorted(str(tuple(r[:5])) for r in rows) == sorted(str(tuple(r)) for r in own_rows)
        docs, plain = spark.createDataFrame(rows, docs.schema), spark.createDataFrame(own_rows, plain.schema)


def test_one_of_the_rows_of_an_id_stays_and_always_the_same(spark):
    rows = [
        (1, "b text", "en", "s", 1), (1, "a text", "en", "s", 2), (1, "a text", "de", "s", 2), (2, None, "en", "s", 0), (2, "z", "en", "s", 0),
        (None, "b text", "en", "s", 1), (None, "b text", "en", "s", 1)
    ]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, DOC).repartition(3)
        found = sorted(map(str, (tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())))
        assert found == sorted(map(str, [(1, "a text", "de", "s", 2), (2, None, "en", "s", 0), (None, "b text", "en", "s", 1), (None, "b text", "en", "s", 1)]))
