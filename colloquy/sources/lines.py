"""Session files as numbered lines, and what kind of session each file holds.

Files are read by splits, so a huge file is many tasks. Within a split lines are counted where they are read; what a later
split of a file starts with is the number of lines in the splits before it, which takes a second look at such files only.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators.periods import Recency

#: The splits that begin within a file are broadcast up to this number (some 15 MB), else they are joined.
MOST_SPLITS = 100_000
NUMBERED = "path string, block long, source_seq long, line string"


def session_lines(spark: SparkSession, path: str | list[str], recency: Recency = Recency()) -> DataFrame:
    """path, source_seq (from 1, blank lines counted but left out) and line, of every .jsonl file under a folder but those
    in `subagents` folders, or of a list of files. Files older than the window are left out before they are read."""
    reader = spark.read.option("recursiveFileLookup", True)
    if isinstance(path, str) and not path.endswith(".jsonl"):
        reader = reader.option("pathGlobFilter", "*.jsonl")
    rows = reader.text(path, lineSep="\n")
    return file_lines(rows.where(recency.holds(F.col("_metadata.file_modification_time")) & ~F.col("_metadata.file_path").contains("/subagents/")))


def file_lines(rows: DataFrame) -> DataFrame:
    """path, source_seq and line of what spark.read.text gives with lineSep "\\n". A byte order mark and carriage returns at line
    ends go; blank lines count and are left out."""
    of = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    numbered = rows.select(*of, "value").mapInArrow(_count_lines, NUMBERED)
    later = rows.where(F.col("_metadata.file_size") > F.col("_metadata.file_block_length")).select(*of).groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    later = later.select("path", "block", before.alias("before")).where("before is not null")
    found = later.take(MOST_SPLITS + 1)  # none where no file is larger than a split
    if found:
        if len(found) <= MOST_SPLITS:
            later = F.broadcast(rows.sparkSession.createDataFrame(found, later.schema))
        numbered = numbered.join(later, ["path", "block"], "left").withColumn("source_seq", F.col("source_seq") + F.coalesce("before", F.lit(0)))
    # a mark, and what is blank, can be told only once numbers are known
    line = F.when(F.col("source_seq") == 1, F.regexp_replace("line", "^\\x{FEFF}", "")).otherwise(F.col("line"))
    return numbered.select("path", "source_seq", line.alias("line")).where(F.trim("line", F.lit(" \t")) != "")


def _count_lines(batches):
    """Numbers within each split; splits come one after the other, each in order."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block, text = batch.columns
        new = np.ones(len(block), bool)
        new[1:] = np.asarray(pc.or_(pc.not_equal(path.slice(1), path.slice(0, len(path) - 1)), pc.not_equal(block.slice(1), block.slice(0, len(block) - 1))))
        if last == (path[0].as_py(), block[0].as_py()):
            new[0] = False
        starts = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        numbers = np.arange(len(new)) - starts + 1 + np.where(starts < 0, n - 1, 0)
        last, n = (path[-1].as_py(), block[-1].as_py()), int(numbers[-1])
        yield pa.RecordBatch.from_arrays([path, block, pa.array(numbers, pa.int64()), pc.replace_substring_regex(text, r"\r$", "")], ["path", "block", "source_seq", "line"])


def parsed(lines: DataFrame) -> DataFrame:
    """Adds v, the line as a variant; null where it isn't JSON."""
    return lines.withColumn("v", F.try_parse_json("line"))


def line_kind(v: Column) -> Column:
    """What the first line of a file says about it: copilot before claude before codex, or null."""
    kind = F.coalesce(V.string(v, "$.type"), F.lit(""))
    chat = (V.integer(v, "$.kind") == 0) & V.string(v, "$.v.sessionId").isNotNull()
    transcript = (kind == "session.start") & F.coalesce(V.string(v, "$.sessionId"), V.string(v, "$.payload.sessionId")).isNotNull()
    codex = (kind == "session_meta") & V.string(v, "$.payload.id").isNotNull()
    return F.when(chat, "copilot-chat").when(transcript, "copilot-transcript").when(V.string(v, "$.sessionId").isNotNull(), "claude").when(codex, "codex")


def _first_lines(lines: DataFrame) -> DataFrame:
    return lines.where("source_seq <= 1").groupBy("path").agg(F.min_by("line", "source_seq").alias("first"))


def detect_kinds(lines: DataFrame) -> DataFrame:
    """path and kind of each file, by its very first line; a file that starts with a blank line is of no kind."""
    paths = lines.groupBy("path").agg(F.min_by("line", "source_seq").alias("line"), F.min("source_seq").alias("at"))
    return paths.select("path", F.when(F.col("at") <= 1, line_kind(F.try_parse_json("line"))).alias("kind"))


def by_kind(lines: DataFrame) -> DataFrame:
    """The lines with their file's kind, which only first lines are parsed for."""
    kinds = _first_lines(lines).select("path", line_kind(F.try_parse_json("first")).alias("kind"))
    return parsed(lines.join(kinds, "path", "left"))
