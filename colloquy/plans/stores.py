"""Queries that write files or a vault from the given tables and read them as the library does."""

import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from ..schemas import TABLES
from ..scratch import shared_folder, staged
from ..sources.lines import file_lines
from ..vault import Vault
from . import derived

#: Files of so many conversations; splits so small that each file is cut into many.
CONVERSATIONS_A_FILE, SPLIT_BYTES = 100, 16_384


@contextmanager
def _splits(spark: SparkSession, size: int):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def numbered_lines(spark, sf_dir) -> DataFrame:
    """Texts of turns written a line each, with carriage returns, to files of 100 conversations, and read in small splits."""
    turns = derived.turns(spark, sf_dir).select(
        F.floor(F.col("session_id") / CONVERSATIONS_A_FILE).alias("file"), "session_id", "source_seq",
        F.concat(F.regexp_replace(F.coalesce("content", F.lit("")), "[\\r\\n]", " "), F.lit("\r")).alias("value")
    )
    place = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    dealt = turns.repartitionByRange("file").sortWithinPartitions("file", "session_id", "source_seq")
    dealt.select("file", "value").write.option("maxRecordsPerFile", 0).partitionBy("file").text(place)
    with _splits(spark, SPLIT_BYTES):
        lines = file_lines(spark.read.option("recursiveFileLookup", True).text(place, lineSep="\n"))
        lines = staged(lines, "numbered")
    return lines.select(F.regexp_extract("path", "file=(-?\\d+)", 1).cast("long").alias("file"), "source_seq", "line")


def _tables(turns: DataFrame) -> dict[str, DataFrame]:
    """Sessions and messages of turns (session_id, source_seq, role, content), without calls and errata."""
    spark = turns.sparkSession
    own = F.concat(F.lit("c"), F.col("session_id").cast("string"))
    day = F.timestamp_add("DAY", (F.col("session_id") % 20).cast("int"), F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)))
    sessions = turns.groupBy("session_id").agg(F.count("*").alias("message_count"), F.sum(F.length("content")).alias("input_tokens")).select(
        own.alias("session_id"), F.lit("claude").alias("source"), F.concat(F.lit("p"), F.col("session_id") % 7).alias("project_slug"), day.alias("started_ts"),
        "message_count", "input_tokens", F.concat(F.lit("/logs/"), own).alias("raw_path")
    )
    messages = turns.select(own.alias("session_id"), F.concat(own, F.lit("-"), F.col("source_seq")).alias("uuid"), "role", "content", "source_seq")
    return {"sessions": sessions, "messages": messages, **{t: spark.createDataFrame([], TABLES[t]) for t in ("tool_calls", "errata")}}


def _reingested(spark, sf_dir) -> Vault:
    """A vault that takes in all conversations, then every third one anew, with its first two turns only, twice."""
    turns = derived.turns(spark, sf_dir).select("session_id", "source_seq", "role", F.coalesce("content", F.lit("")).alias("content"))
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}").init()
    vault.replace(_tables(turns))
    again = turns.where("session_id % 3 = 0 and source_seq < 2").withColumn("content", F.concat(F.lit("again: "), "content"))
    for _ in range(2):
        vault.replace(_tables(again))
    return vault


def vault_reingest(spark, sf_dir) -> DataFrame:
    return _reingested(spark, sf_dir).table("messages").select("session_id", "source_seq", "role", "content")


def vault_search(spark, sf_dir) -> DataFrame:
    """Messages that hold a word, from the index of a vault after sessions were replaced."""
    found = _reingested(spark, sf_dir).table("postings").where("term = 'again'").groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.size("places")).alias("places"))
    return found


def vault_rollup(spark, sf_dir) -> DataFrame:
    """The rollup after a report of the whole month, sessions replaced, and a report of a week: other days stay as they were."""
    turns = derived.turns(spark, sf_dir).select("session_id", "source_seq", "role", F.coalesce("content", F.lit("")).alias("content"))
    vault = Vault(spark, f"{shared_folder(spark)}/vault-{uuid.uuid4().hex}").init()
    vault.replace(_tables(turns))
    now = datetime(2024, 1, 30, tzinfo=timezone.utc)
    vault.report("custom", "2024-01-01", "2024-01-30", now=now)
    vault.replace(_tables(turns.where("session_id % 3 = 0 and source_seq < 2")))
    vault.report("custom", "2024-01-08", "2024-01-14", now=now)
    return vault.rollup().select("date", F.col("project").alias("project"), "session_count", "message_count", *report.TOKENS[:1])


_AGAIN = """t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
  a AS (SELECT conv_id, turn, role, text FROM t WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, turn, role, 'again: ' || text FROM t WHERE conv_id % 3 = 0 AND turn < 2)"""
_DAY = "CAST(DATE '2024-01-01' + CAST(conv_id % 20 AS INTEGER) AS DATE)"
STORES = {
    "numbered_lines": (
        numbered_lines,
        """WITH r AS (SELECT CAST(floor(conv_id / 100) AS BIGINT) AS file, row_number() OVER (PARTITION BY floor(conv_id / 100) ORDER BY conv_id, turn) AS source_seq,
             regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') AS line FROM conversations)
           SELECT file, source_seq, line FROM r WHERE trim(line, ' ' || chr(9)) <> ''"""
    ),
    "vault_reingest": (vault_reingest, f"WITH {_AGAIN} SELECT 'c' || conv_id AS session_id, turn AS source_seq, role, text AS content FROM a"),
    "vault_search": (
        vault_search,
        f"""WITH {_AGAIN}, w AS (SELECT conv_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x = 'again')) AS n FROM a)
           SELECT 'c' || conv_id AS session_id, count(*) AS messages, CAST(sum(n) AS BIGINT) AS places FROM w WHERE n > 0 GROUP BY conv_id"""
    ),
    "vault_rollup": (
        vault_rollup,
        f"""WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, {_DAY} AS date FROM conversations),
           k AS (SELECT * FROM t WHERE NOT (date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14') OR conv_id % 3 <> 0 OR turn < 2)
           SELECT date, 'p' || conv_id % 7 AS project, count(DISTINCT conv_id) AS session_count, count(*) AS message_count, CAST(sum(n) AS BIGINT) AS input_tokens
           FROM k GROUP BY ALL"""
    ),
}
