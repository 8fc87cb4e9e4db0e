"""Running counts and sums along a key whose rows may be a large part of the table.

Rows are dealt by ranges of (key, order), so a key with many rows lies in several blocks, and numpy runs along each block by
itself. Of a block only its first key and what its last key has gathered come to the driver: one row a block, whatever the
number of rows. From these each block gets what its first key had in the blocks before."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut, named


@dataclass(frozen=True)
class Total:
    """The running sum of a column of integers."""

    column: str


@dataclass(frozen=True)
class Polynomial:
    """The running sum of column * base^place modulo a prime below 2^31; the column holds 0 to modulus - 1. The value before
    the row comes as <name>_before."""

    column: str
    modulus: int
    base: int


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo modulus."""
    out = np.ones(1, np.int64)
    while len(out) <= n:
        out = np.concatenate([out, out * pow(base, len(out), modulus) % modulus])
    return out[: n + 1]


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    found = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
    return np.concatenate([[True], np.asarray(found.to_numpy(zero_copy_only=False), bool)])


def _walk(key: str, sums: dict, names: list[str]):
    def walk(batches):
        block, last, carried = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(names.index(key))
            new = _changes(column)
            goes_on = carried is not None and column[0].as_py() == last
            starts = np.flatnonzero(new)
            segment = np.cumsum(new) - 1
            first = segment == 0
            place = np.arange(1, n + 1) - starts[segment] + np.where(first & goes_on, carried["place"] if goes_on else 0, 0)
            out, ends = {"block": np.full(n, block, np.int32), "place": place}, {"place": place[-1]}
            for name, s in sums.items():
                values = np.asarray(batch.column(names.index(s.column)), np.int64)
                if isinstance(s, Polynomial):
                    values = values * _powers(s.base, s.modulus, int(place.max()))[place] % s.modulus
                    out[f"{name}_own"] = values
                gathered = np.cumsum(values)
                gathered = gathered - (gathered[starts] - values[starts])[segment] + np.where(first & goes_on, carried[name] if goes_on else 0, 0)
                out[name] = gathered % s.modulus if isinstance(s, Polynomial) else gathered
                ends[name] = out[name][-1]
            last, carried = column[n - 1].as_py(), ends
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out.values())], [*names, *out])

    return walk


def block_scan(rows: DataFrame, key: str, order: list[Column], sums: dict[str, Total | Polynomial] | None = None, tables: Scratch | None = None) -> DataFrame:
    """The rows with `place` (from 1 within the key, along the order) and a running column for each of the sums, the row itself
    included. The order must be total, but for rows that are equal in all columns. The rows are written once, to `tables` if
    given, as they lie in their blocks. Names of columns in between, which `rows` may not have: block, those of the sums and, for
    polynomials, these with _own and _before."""
    sums, columns = sums or {}, rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("block", T.IntegerType()), T.StructField("place", T.LongType())])
    for name, s in sums.items():
        for added in ([f"{name}_own"] if isinstance(s, Polynomial) else []) + [name]:
            schema = schema.add(added, T.LongType())
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    local = (tables.cut if tables else cut)(dealt.mapInArrow(_walk(key, sums, columns), schema), "scan")
    gathered = F.struct(F.struct(key).alias("k"), "place", *sums)
    blocks = local.groupBy("block").agg(
        F.min(F.struct(key)).alias("first"), F.max_by(gathered, F.struct(F.struct(key), "place")).alias("last")
    ).orderBy("block").collect()  # one row a block
    before, carried = [], None
    for b in blocks:
        held = carried if carried is not None and carried["k"] == b["first"] else None
        if held:
            powers = [pow(s.base, held["place"], s.modulus) for s in sums.values() if isinstance(s, Polynomial)]
            before.append((b["block"], held["place"], [held[name] for name in sums], powers))
        carried = b["last"].asDict()
        if held and b["first"] == b["last"]["k"]:
            for name, s in sums.items():
                carried[name] = held[name] + carried[name] * (pow(s.base, held["place"], s.modulus) if isinstance(s, Polynomial) else 1)
                if isinstance(s, Polynomial):
                    carried[name] %= s.modulus
            carried["place"] += held["place"]
    return _joined(local, key, columns, sums, blocks, before)


def _joined(local: DataFrame, key: str, columns: list[str], sums: dict, blocks: list, before: list) -> DataFrame:
    """The rows of the blocks with what their first keys had before. `before` has a row a block at most, so it is broadcast."""
    kept = named(columns)
    if before:
        first = {b["block"]: b["first"][0] for b in blocks}
        kind = next(f.dataType.simpleString() for f in local.schema if f.name == key)
        offsets = local.sparkSession.createDataFrame(
            [(*row, first[row[0]]) for row in before], f"_b int, _place long, _sums array<long>, _powers array<long>, _key {kind}"
        )
        local = local.join(F.broadcast(offsets), (F.col("block") == F.col("_b")) & F.col(key).eqNullSafe(F.col("_key")), "left")
        held = F.col("_b").isNotNull()
    else:
        local = local.select("*", F.lit(0).cast("long").alias("_place"), F.array().cast("array<long>").alias("_sums"), F.array().cast("array<long>").alias("_powers"))
        held = F.lit(False)
    out, powers = [*kept, (F.when(held, F.col("_place")).otherwise(0) + F.col("place")).alias("place")], 0
    for k, (name, s) in enumerate(sums.items()):
        had = F.when(held, F.col("_sums")[k]).otherwise(F.lit(0).cast("long"))
        if isinstance(s, Polynomial):
            power = F.when(held, F.col("_powers")[powers]).otherwise(F.lit(1).cast("long"))
            powers += 1
            whole = (had + F.col(name) * power) % s.modulus
            out += [whole.alias(name), F.pmod(whole - F.col(f"{name}_own") * power % s.modulus, F.lit(s.modulus)).alias(f"{name}_before")]
        else:
            out.append((had + F.col(name)).alias(name))
    return local.select(*out)
