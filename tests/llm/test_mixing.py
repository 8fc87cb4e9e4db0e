import re

import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing


def fill(sizes):
    """Rounds of redistribution, as in the definition."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def test_targets_are_the_fixed_point(spark):
    for sizes in ({"a": 100, "b": 5000, "c": 7, None: 300, "é": 1}, {"x": 10}, {"a": 0, "b": 0}, {"a": 0, "b": 50}, {f"s{k}": 10 + k * k for k in range(20)}):
        found = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()}
        assert found == pytest.approx(fill(sizes))


def test_mix_comes_near_its_targets(spark, documents, empty, rng):
    rows = [
        (k, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "d"])) for k in range(900)
    ] + [(5000, None, "a"), (None, "x y", "b"), (1, "w w", "a")]
    docs = documents(rows).withColumn("source", F.when(F.col("source") == "d", None).otherwise(F.col("source"))).withColumn("taken", F.lit("clash"))
    out = mixing.mix(docs)
    found = out.collect()
    assert sorted(map(str, (r[:2] for r in found))) == sorted(map(str, (r[:2] for r in docs.collect())))
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
        assert own[0].source_size == sum(r.size for r in own)
    assert all(r.taken == r.size * r.repeats and r.repeats <= 2 and r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in found)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, found))
    repeated = mixing.repeat_documents(out, ["doc_id", "text"])
    assert repeated.count() == sum(r.repeats for r in found)
    assert mixing.mix(empty).count() == 0
