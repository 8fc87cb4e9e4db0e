"""The trie of all conversations' prefixes: which conversations begin alike, how far, and what storing a common beginning once
would save.

A prefix is known by its polynomial fingerprint, a numpy scan along each conversation. Prefixes of one depth and fingerprint
are candidates for one node. Every candidate's last turn and its prefix before that are compared with the group's
representative, so, depth by depth, all its turns are; a group that holds different ones is split by comparing whole
prefixes. A node is then (its smallest member, depth): a conversation owns a chain of nodes, from where it is first the
smallest to its end, and what lies below a node is summed over chains, by doubling, instead of over levels.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut
from .scans import Polynomial, Total, block_scan

#: Two primes below 2^31 and a base for each; both remainders together make a fingerprint of 62 bits.
MODULI, BASES = (2**31 - 1, 2**31 - 19), (1_000_003, 998_244_353)
#: Ids of a node go to its digest in strings of about so many characters.
CHUNK_CHARS = 1 << 16
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def place_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role and text of all rows, by turn (null first), then role, then text. Null roles and texts become
    empty; rows without a conv_id are a conversation of their own, of id null. Other columns are left out."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("_row")  # rows that are equal else can be dealt to several tasks
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    return block_scan(rows, "conv_id", order).select("conv_id", "place", "role", "text")


def prefix_trie(turns: DataFrame, ids: DataFrame | None = None, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """A row for each node, that is for each different sequence of first turns (role, text), from the root without turns:
    conv_id (the smallest member; members are the conversations that begin with the sequence), depth, parent_conv_id (null for
    the root), n_convs (members), n_children, n_leaves (nodes without children in the subtree, top included), saved_tokens (over
    the subtree, (n_convs - 1) times the code points of the node's last text) and ends_sha256 (of the ids of the members that
    end here, ascending, with commas between).

    `turns` has conv_id (whole numbers), turn, role and text, in the order of place_turns; `ids` may add conversations without
    turns (conv_id). Rows without a conv_id are ignored, repeated rows are turns like others, and of nothing there is no trie.
    Fingerprints only propose: with any moduli the result is the same.
    """
    turns = turns.where("conv_id is not null")
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id"))
    if ids is not None:
        known = known.unionByName(ids.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")))
    with Scratch(turns.sparkSession) as tables:
        prefixes = tables.cut(_prefixes(tables, turns, known.distinct(), moduli), "prefixes")
        turn = F.struct("parent", "role", "text")
        groups = prefixes.groupBy("depth", "fp").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(turn).alias("a"), F.max(turn).alias("b"))
        groups = tables.cut(groups.select(
            "depth", "fp", F.lit(0).alias("part"), "conv_id", "n_convs", F.char_length("a.text").cast("long").alias("chars"), F.col("a.parent").alias("parent"),
            F.lit(0).alias("parent_part"), F.expr("a <=> b").alias("same")
        ), "groups")
        ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "fp")).alias("e")).select("conv_id", "e.*", F.lit(0).alias("part"))
        if groups.where("not same").limit(1).isEmpty():
            nodes = groups.drop("same")
        else:
            nodes, ends = _split(tables, prefixes, groups, ends)
        linked = tables.cut(_linked(nodes), "linked")
        return _rolled_up(tables, linked, _end_digests(tables, ends))


def _prefixes(tables: Scratch, turns: DataFrame, ids: DataFrame, moduli: tuple[int, int]) -> DataFrame:
    """conv_id, depth, fp, parent (the fingerprint before), role and text of all prefixes, the empty one included."""
    hashed = F.xxhash64("role", "text")
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("_row")
    ).select("*", *[F.pmod(hashed, F.lit(m)).alias(f"t{k}") for k, m in enumerate(moduli)])
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    found = block_scan(rows, "conv_id", order, {f"f{k}": Polynomial(f"t{k}", m, BASES[k] % m or 1) for k, m in enumerate(moduli)}, tables)
    joined = lambda a, b: F.col(a) * (1 << 31) + F.col(b)
    found = found.select("conv_id", F.col("place").alias("depth"), joined("f0", "f1").alias("fp"), joined("f0_before", "f1_before").alias("parent"), "role", "text")
    zero = F.lit(0).cast("long")
    return found.unionByName(
        ids.select("conv_id", zero.alias("depth"), zero.alias("fp"), F.lit(None).cast("long").alias("parent"), F.lit("").alias("role"), F.lit("").alias("text"))
    )


def _split(tables: Scratch, prefixes: DataFrame, groups: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends where some groups hold different prefixes. From its first such group on, each conversation is compared
    whole, turn by turn, with the smallest one of its group; those that differ are compared with the smallest of them, and so on.
    All members of a group are touched or none, as equal parents belong to equal groups."""
    bad = groups.where("not same").select("depth", "fp")
    touched = tables.cut(prefixes.join(bad, ["depth", "fp"], "left_semi").groupBy("conv_id").agg(F.min("depth").alias("since")), "touched")
    whole = tables.cut(prefixes.where("depth > 0").join(touched, "conv_id"), "whole")
    left, found, part = tables.cut(whole.where("depth >= since").select("conv_id", "depth", "fp"), "left"), [], 0
    mine = whole.select("conv_id", "depth", F.struct("role", "text").alias("own"))
    theirs = whole.select(F.col("conv_id").alias("rep"), "depth", F.struct("role", "text").alias("other"))
    while not left.limit(1).isEmpty():
        rows = tables.cut(left.join(left.groupBy("depth", "fp").agg(F.min("conv_id").alias("rep")), ["depth", "fp"]), "rows")
        pairs = rows.where("conv_id <> rep").groupBy("conv_id", "rep").agg(F.max("depth").alias("deepest"))
        unlike = pairs.join(mine, "conv_id").where("depth <= deepest").join(theirs, ["rep", "depth"], "left").where("not own <=> other")
        unlike = tables.cut(unlike.groupBy("conv_id", "rep").agg(F.min("depth").alias("unlike")), "unlike")
        judged = tables.cut(rows.join(unlike, ["conv_id", "rep"], "left").select("*", F.expr("unlike is null or depth < unlike").alias("same")), "judged")
        found.append(judged.where("same").select("conv_id", "depth", "fp", F.lit(part).alias("part")))
        left, part = judged.where("not same").select("conv_id", "depth", "fp"), part + 1
    parts = tables.cut(reduce(DataFrame.unionByName, found), "parts")
    made = parts.groupBy("depth", "fp", "part").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    made = made.join(whole.select("conv_id", "depth", "parent", F.char_length("text").cast("long").alias("chars")), ["conv_id", "depth"])
    above = parts.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("part").alias("parent_part"))
    made = made.join(above, ["conv_id", "depth"], "left").fillna(0, ["parent_part"])
    nodes = groups.drop("same").join(parts.select("depth", "fp").distinct(), ["depth", "fp"], "left_anti").unionByName(made)
    ends = ends.drop("part").join(parts, ["conv_id", "depth", "fp"], "left").fillna(0, ["part"])
    return nodes, ends


def _linked(nodes: DataFrame) -> DataFrame:
    """The nodes with their parents' smallest members."""
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent"), F.col("part").alias("parent_part"), F.col("conv_id").alias("parent_conv_id")
    )
    return nodes.join(above, ["depth", "parent", "parent_part"], "left").select("conv_id", "depth", "fp", "part", "parent_conv_id", "n_convs", "chars")


def _rolled_up(tables: Scratch, linked: DataFrame, digests: DataFrame) -> DataFrame:
    """Sums over subtrees: over the chains below each chain, then along each chain from its end."""
    kids = linked.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = linked.join(kids, ["conv_id", "depth"], "left").fillna(0, ["n_children"])
    own = tables.cut(own.select("*", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "own")
    chains = tables.cut(own.groupBy("conv_id").agg(
        F.min("depth").alias("head"), F.min_by("parent_conv_id", "depth").alias("above"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")
    ), "chains")
    below = _sums_below(tables, chains)
    hung = chains.select("conv_id", "head", "above").join(below, "conv_id").where("above is not null")
    hung = hung.groupBy(F.col("above").alias("conv_id"), (F.col("head") - 1).alias("depth")).agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    values = own.join(hung, ["conv_id", "depth"], "left").fillna(0, ["l", "s"]).select(
        "conv_id", "depth", "fp", "part", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.col("l")).alias("leaf"), (F.col("saved") + F.col("s")).alias("saved")
    )
    summed = block_scan(values, "conv_id", [F.col("depth").desc()], {"n_leaves": Total("leaf"), "saved_tokens": Total("saved")})
    out = summed.join(digests, ["depth", "fp", "part"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )


def _sums_below(tables: Scratch, chains: DataFrame) -> DataFrame:
    """conv_id, leaf and saved of each chain and all that hang below it. After k rounds a chain has what is less than 2^k chains
    below and knows the chain 2^k above, so rounds are as many as the nesting of chains has binary digits."""
    state = chains.select("conv_id", "above", "leaf", "saved")
    while not state.where("above is not null").limit(1).isEmpty():
        rising = state.where("above is not null")
        more = rising.groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
        jump = rising.select(F.col("conv_id").alias("above"), F.col("above").alias("next"))
        state = state.join(more, "conv_id", "left").join(jump, "above", "left").fillna(0, ["l", "s"])
        state = tables.cut(state.select("conv_id", F.col("next").alias("above"), (F.col("leaf") + F.col("l")).alias("leaf"), (F.col("saved") + F.col("s")).alias("saved")), "below")
    return state.select("conv_id", "leaf", "saved")


def _end_digests(tables: Scratch, ends: DataFrame) -> DataFrame:
    """depth, fp, part and sha256 of the ids that end there. SHA-256 runs from the first byte to the last, so one task has to take a
    node's ids in order; they come to it as long strings, joined where they were sorted, and pass through it as a stream."""
    node = ["depth", "fp", "part"]
    names = [*node, "first", "ids"]

    def key(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([np.asarray(batch.column(k), np.int64) for k in range(3)])

    def starts(nodes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], (nodes[:, 1:] != nodes[:, :-1]).any(0)]))

    def joined(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, ids = key(batch), batch.column(3).to_pylist()
            out, at = ([], [], [], [], []), starts(nodes)
            for a, b in zip(at, [*at[1:], len(ids)]):
                step = max(1, CHUNK_CHARS // 20)
                for c in range(a, b, step):
                    for column, value in zip(out, (*nodes[:, a].tolist(), ids[c], ",".join(map(str, ids[c : min(b, c + step)])))):
                        column.append(value)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    def digested(batches):
        last, state = None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.int32()), pa.array([state.hexdigest()])], [*node, "sha256"]
            )

        for batch in batches:
            out = ([], [], [], [])
            for *at, _, ids in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if at == last:
                    state.update(b",")
                else:
                    if last is not None:
                        for column, value in zip(out, (*last, state.hexdigest())):
                            column.append(value)
                    last, state = at, hashlib.sha256()
                state.update(ids.encode())
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [*node, "sha256"])
        if last is not None:
            yield row()

    rows = ends.select(*node, "conv_id").repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    chunks = tables.cut(rows.mapInArrow(joined, "depth long, fp long, part int, first long, ids string"), "ids")
    dealt = chunks.repartition(*node).sortWithinPartitions(*node, "first")
    return cut(dealt.mapInArrow(digested, "depth long, fp long, part int, sha256 string"), "digests")


def splice_beginnings(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with beginnings taken from others: every conv_id c gets the first h turns of c - c % 100 (all if there are
    fewer, none if there is no such conversation), then its own turns after its first h, with h = crc32(c as text) % 6; % keeps
    the sign. Returns their turns (conv_id, turn, role, text) and their ids, turnless ones too. Rows without a conv_id are left out."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    placed = place_turns(rows).withColumnRenamed("place", "turn")
    cuts = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    ids = rows.select("conv_id").distinct()
    givers = placed.where("conv_id % 100 = 0 and turn <= 5").withColumnRenamed("conv_id", "giver")
    taken = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("giver"), cuts.alias("h")).join(givers, "giver").where("turn <= h")
    return placed.where(F.col("turn") > cuts).unionByName(taken.select("conv_id", "turn", "role", "text")), ids
