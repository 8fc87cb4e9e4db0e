"""Reply trees to conversations: paths from the root to a leaf, ranked by score, each formatted as one conversation of a chat
template with a loss mask.

Every message knows the message 2^k above after k joins of the table with itself, with the score between; that gives the
score of each path. The messages of the chosen paths come from the leaves upwards by the same jumps, longest first, so a path
of n messages takes about log n joins either way, and only trees that are long enough take part in the later ones. Texts meet
their paths once, at the end. A conversation is stored as one row, or as consecutive ones where it is long.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, cut

# The template: fixed values.
START, END, LEARNED = "<|im_start|>", "<|im_end|>\n", "assistant"
#: A path is written in parts of so many turns, and a part is closed when it has this many characters.
TURNS_A_PART, CHARS_A_PART = 256, 4_000_000
PARTS = "path string, first long, n_turns long, whole boolean, formatted string, loss array<struct<start:int,end:int>>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escaped(text: str | Column) -> Column:
    """A text in which `<|` never stands: between `<` and `|` comes one more backslash than there were."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _header(role: str) -> Column:
    """Roles are one line: backslashes and line ends in them are escaped too."""
    return escaped(F.replace(F.replace(F.col(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role(header: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(header))


def chosen_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """tree, rank (from 1), depth (from 1) and message of the best paths of each tree, `paths` of them at most.

    messages: tree, message (unique in its tree), parent, score. A message whose parent is null or missing is a root; one that
    never reaches a root, being in a circle, is in no path. A path's score is the sum of its messages' (null: 0); equal scores are
    ranked by their leaves' ids.
    """
    with Scratch(messages.sparkSession) as tables:
        rows = messages.select("tree", "message", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        there = rows.select("tree", F.col("message").alias("parent"), F.lit(True).alias("there"))
        sizes = rows.groupBy("tree").agg(F.count("*").alias("size"))
        state = rows.join(there, ["tree", "parent"], "left").join(sizes, "tree").select(
            "tree", "message", F.when(F.col("there"), F.col("parent")).alias("above"), "score", F.lit(1).cast("long").alias("depth"), "size"
        )
        state, jumps, reach = tables.cut(state, "state"), [], 1
        most = state.agg(F.max("size")).first()[0] or 0
        while reach < most:
            # above: the message `reach` higher; score and depth: over the `reach` messages up to there
            jumps.append(state.where(f"above is not null and size > {reach}").select("tree", "message", "above"))
            higher = state.where(f"size > {reach}").select(
                "tree", F.col("message").alias("above"), F.col("above").alias("a"), F.col("score").alias("s"), F.col("depth").alias("d")
            )
            grown = state.where(f"above is not null and size > {reach}").join(higher, ["tree", "above"]).select(
                "tree", "message", F.col("a").alias("above"), (F.col("score") + F.col("s")).alias("score"), (F.col("depth") + F.col("d")).alias("depth"), "size"
            )
            state, reach = tables.cut(state.where(f"above is null or size <= {reach}").unionByName(grown), "state"), 2 * reach
        parents = rows.where("parent is not null").select("tree", F.col("parent").alias("message"))
        leaves = state.where("above is null").join(parents, ["tree", "message"], "left_anti")
        best = Window.partitionBy("tree").orderBy(F.col("score").desc(), "message")
        found = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= paths).select("tree", "rank", "depth", "message")
        found = tables.cut(found, "leaves")
        for k in range(len(jumps) - 1, -1, -1):
            up = found.where(F.col("depth") > 2**k).join(jumps[k], ["tree", "message"])
            up = up.select("tree", "rank", (F.col("depth") - 2**k).alias("depth"), F.col("above").alias("message"))
            found = tables.cut(found.unionByName(up), "path")
        return cut(found, "paths")


def _packed(batches):
    """Turns of a path, in order, to parts."""
    path, out = None, None

    def row():
        return (path, out["first"], out["n"], out["first"] == 1 and out["n"] == out["length"], "".join(out["pieces"]), out["loss"])

    kind = pa.schema([
        ("path", pa.string()), ("first", pa.int64()), ("n_turns", pa.int64()), ("whole", pa.bool_()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    ])
    for batch in batches:
        rows = []
        for name, part, depth, length, header, text, learned in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if out is not None and (name != path or part != out["part"] or out["chars"] >= CHARS_A_PART):
                rows.append(row())
                out = None
            if out is None:
                path, out = name, {"part": part, "first": depth, "n": 0, "length": length, "chars": 0, "pieces": [], "loss": []}
            start = out["chars"] + len(header)
            if learned:
                out["loss"].append({"start": start, "end": start + len(text)})
            out["pieces"] += [header, text, END]
            out["chars"], out["n"] = start + len(text) + len(END), out["n"] + 1
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, kind)], schema=kind)
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), kind)], schema=kind)


def format_conversations(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The best paths of each tree as conversations: path (`<tree>#<rank>`), first (the first turn's place), n_turns, whole (whether
    this row is all of its conversation), formatted and loss (code points of `formatted` from start to before end, for each turn of
    an assistant: its text and nothing else). Conversations of more than 256 turns or 4 million characters are several rows.

    messages: tree, message, parent, role, text, score; other columns are ignored. Null roles and texts are empty. Rows without a
    message id are left out; trees without an id are one tree; of rows with one tree and message the least counts, by parent, score, role and text.
    Control strings in roles and texts are escaped, and `read_turns` gives back what was there. Without rows there are none."""
    whole = F.struct("parent", "score", "role", "text")
    rows = messages.where("message is not null").select(
        F.coalesce(F.col("tree").cast("string"), F.lit("null")).alias("tree"), "message", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).groupBy("tree", "message").agg(F.min(whole).alias("m")).select("tree", "message", "m.*")
    with Scratch(messages.sparkSession) as tables:
        rows = tables.cut(rows, "messages")
        found = chosen_paths(rows, paths)
        lengths = found.groupBy("tree", "rank").agg(F.max("depth").alias("length"))
        placed = found.join(lengths, ["tree", "rank"]).join(rows.select("tree", "message", "role", "text"), ["tree", "message"])
        turns = placed.select(
            F.concat("tree", F.lit("#"), F.col("rank").cast("string")).alias("path"), F.expr(f"(depth - 1) div {TURNS_A_PART}").alias("part"), "depth", "length",
            F.concat(F.lit(START), _header("role"), F.lit("\n")).alias("header"), escaped("text").alias("text"), (F.col("role") == LEARNED).alias("learned")
        )
        return cut(turns.repartition("path", "part").sortWithinPartitions("path", "part", "depth").mapInArrow(_packed, PARTS), "chats")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, as they were."""
    return [(_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _digested(batches):
    """Parts of conversations, in order, to one row each. Nothing of a conversation is kept but the states of its digests."""
    path, out = None, None
    names = ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def row():
        return path, out["n"], out["turns"].hexdigest(), out["learned"], out["loss"].hexdigest(), out["chars"]

    for batch in batches:
        rows = []
        for name, formatted, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if name != path:
                if out is not None:
                    rows.append(row())
                path, out = name, {"n": 0, "learned": 0, "chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
            for role, text in read_turns(formatted):
                out["n"] += 1
                out["turns"].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                out["learned"] += len(text)
                out["loss"].update(text.encode())
            out["chars"] += len(formatted)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types)], names)


def chat_digests(spark: SparkSession, path: str) -> DataFrame:
    """From files that `format_conversations` made: path, n_turns, turns_sha256 (role, line end, text, line end of each turn),
    loss_chars, loss_sha256 (of the text under the loss mask) and formatted_chars. Conversations of one row are digested where
    they are read; the parts of longer ones pass through one task in order, as a digest asks for."""
    parts = spark.read.parquet(path)
    kind = "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rest = parts.where("not whole").repartition("path").sortWithinPartitions("path", "first")
    columns = ("path", "formatted", "loss")
    return parts.where("whole").select(*columns).mapInArrow(_digested, kind).unionByName(rest.select(*columns).mapInArrow(_digested, kind))


def conversation_messages(placed: DataFrame) -> DataFrame:
    """Conversations (conv_id, place, role, text) as trees without branches: each turn answers the one before."""
    before = F.when(F.col("place") > 1, F.col("place") - 1)
    return placed.select(
        F.col("conv_id").alias("tree"), F.col("place").alias("message"), before.alias("parent"), "role", "text", F.lit(None).cast("double").alias("score")
    )
