"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the words in proportion to its weight. A source can give at most `max_epochs` times its
own words; what it cannot give is dealt to the others in proportion to their weights, until no source is above its cap.
Instead of rounds of redistribution the fixed point is found at once: sources sorted by cap/weight saturate in that
order, so running sums over the sorted sources tell where saturation ends.

A source's documents are then repeated whole `floor(target / size)` times, and the remaining fraction is taken from the
documents with the smallest seeded hash, up to the hash at which the remaining words are used up. That hash is found from
word sums over hash ranges, so no task ever sees more than one range of one source.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, named

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Ranges into which hashes are dealt before the exact threshold is searched within one of them.
RANGE_BITS = 12
HASH_BITS = 48
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str = SEED, key: str = "doc_id", text: str = "text") -> Column:
    """A hash of the row's id and text in [0, 2**48), the same in every run. Rows without an id draw by their texts."""
    parts = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size. Adds weight and target. One row a source; the windows hold sources, never documents.

    Sources are weighed in code point order, null last, by the weights in turn. A source without words gets a target of 0.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    x = x.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("words", F.sum("source_size").over(everything) * F.lit(share))
    x = x.withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    x = x.withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("heavy"))
    x = x.withColumn(
        "level",
        F.first(F.when(~F.col("full"), F.col("left") / F.col("heavy")), ignorenulls=True).over(
            by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        )
    )
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return x.select("source", "source_size", "weight", target.alias("target"))


def mixing_plan(sized: DataFrame, **options) -> DataFrame:
    """sized: source, size, draw. Returns source, source_size, weight, target, whole, below: a document is repeated `whole`
    times, and once more if its draw is at most `below` (null: never)."""
    targets = water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    tables = Scratch(sized.sparkSession)
    targets = tables.cut(targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    coarse = F.shiftright("draw", HASH_BITS - RANGE_BITS)
    ranges = sized.groupBy("source", coarse.alias("span")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("words").over(running), F.lit(0)))
    at = ranges.join(
        targets.select(F.col("source").alias("s"), "need"), F.col("source").eqNullSafe(F.col("s"))
    ).where((F.col("ahead") < F.col("need")) & (F.col("ahead") + F.col("words") >= F.col("need")))
    at = tables.cut(at.select("source", "span", "ahead", "need"), "mix-ranges")  # one range a source

    edge = sized.withColumn("span", coarse).alias("d").join(
        at.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.span") == F.col("r.span"))
    )
    edge = edge.groupBy(F.col("r.source").alias("source"), "ahead", "need", "draw").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("so_far", F.col("ahead") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
    first_draw = F.shiftleft(F.col("span").cast("long"), HASH_BITS - RANGE_BITS) - 1
    taken = edge.where(F.col("so_far") + F.col("words") / 2 <= F.col("need")).groupBy("source").agg(F.max("draw").alias("last"))
    limit = at.select("source", first_draw.alias("floor")).alias("a").join(taken.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")), "left")
    limit = limit.select(F.col("a.source").alias("at_source"), F.coalesce("last", "floor").alias("below"))
    plan = targets.join(limit, F.col("source").eqNullSafe(F.col("at_source")), "left")
    with tables:
        return cut(plan.select("source", "source_size", "weight", "target", "whole", "below"), "mix-plan")


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """docs with size, source_size, target, repeats and taken (= size * repeats) added, which replace columns so named; all
    other columns stay, whatever their names.

    Null texts have size 0 and are kept with the repeats of their draw. Rows with the same doc_id and text share a draw and
    so are taken together; rows that differ in either draw for themselves, also those without an id. A null source is a
    source. An empty table gives an empty table.
    """
    rest = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "repeats", "taken")]
    rows = docs.select(*named(rest), n_words().alias("_mix_size"), draw(seed).alias("_mix_draw"))
    with Scratch(docs.sparkSession) as tables:
        sized = tables.cut(rows.select("source", F.col("_mix_size").alias("size"), F.col("_mix_draw").alias("draw")), "mix-sizes")
        plan = mixing_plan(sized, **options)
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "source_size", "target", "whole", "below")])
    repeats = F.col("_mix_whole") + F.coalesce(F.col("_mix_draw") <= F.col("_mix_below"), F.lit(False)).cast("long")
    both = rows.join(plan, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_repeats", repeats)
    own = {"size": "_mix_size", "source_size": "_mix_source_size", "target": "_mix_target", "repeats": "_mix_repeats"}
    return both.select(*named(rest), *[F.col(c).alias(name) for name, c in own.items()], (F.col("_mix_size") * F.col("_mix_repeats")).alias("taken"))


def repeat_documents(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of each document, one row for every repeat."""
    again = F.explode(F.array_repeat(F.lit(0), F.col("repeats").cast("int"))).alias("_mix_again")
    return mixed.where("repeats > 0").select(*named(columns), again).select(*named(columns))
