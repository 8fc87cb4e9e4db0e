"""Documents to training tokens in five stages: drop toxic documents, keep one of each group of near duplicates, cut out
repeated passages, mix sources to their target weights, encode into pieces with their places in the text.

Columns beside doc_id, text and source travel in a struct, so their names never meet those that the operators add."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import minhash, mixing, piece_codec, sentence_spans, toxicity
from colloquy.llm.common import Scratch, cut, id_crc, named, table
from colloquy.llm.queries import learn_toxicity

MODEL = "piece_bpe_32k.model"
OWN = ("doc_id", "text", "source")
#: SQL has no automata, learned weights, samples or pieces; tests compare the stages with plain versions.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """OWN as they are and all other columns as _rest."""
    rest = named([c for c in docs.columns if c not in OWN])
    return docs.select(*OWN, (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in OWN else F.col("_rest").getField(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; null and empty texts do. The lexicon is learned from the labelled documents among
    them, as in op1; without labels nothing is dropped. Repeated rows go or stay together."""
    lexicon = learn_toxicity(docs, table(spark, sf_dir, "labels"), id_crc("doc_id") % 5 != 0)
    scored = toxicity.toxicity_scores(_packed(docs), lexicon, (*OWN, "_rest"))
    return _unpacked(scored.where("tox_score < 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each class; of rows with the same doc_id the one with the least text, then the
    least other columns. Rows without an id stay."""
    classes = minhash.near_duplicate_classes(docs.select("doc_id", "text"))
    first = cut(classes.where("doc_id = class_id").select(F.col("doc_id").alias("_kept_id")).distinct(), "kept")
    columns = [f.name for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    order = F.struct("text", *named([c for c in columns if c != "text"])).alias("_order")
    rows = docs.select(F.col("doc_id").alias("_id"), F.struct("*").alias("_doc"), order)
    kept = rows.join(first, F.col("_id") == F.col("_kept_id"), "left_semi").groupBy("_id").agg(F.min_by("_doc", "_order").alias("_doc"))
    return kept.select("_doc").unionByName(rows.where("_id is null").select("_doc")).select("_doc.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the passages that stand in an earlier document; n_chars follows the text."""
    rows, out = sentence_spans.remove_repeats(_packed(docs)), []
    for f in docs.schema:
        kept = F.col(f.name) if f.name in OWN else F.col("_rest").getField(f.name)
        if f.name == "n_chars" and isinstance(f.dataType, T.NumericType):
            kept = F.when(F.col("n_removed") > 0, F.length("text").cast(f.dataType)).otherwise(kept)
        out.append(kept.alias(f.name))
    return rows.select(*out)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to twice."""
    return _unpacked(mixing.repeat_documents(mixing.mix(_packed(docs)), [*OWN, "_rest"]), docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, starts and ends of each row; null texts are empty ones."""
    import public_tokenizers

    return piece_codec.encode_documents(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", drop_repeats),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each is written, and what it was made from is removed then; the last stays a plan."""
    docs, tables = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        former, docs = docs, tables.cut(stage(spark, docs, sf_dir), name)
        if k:
            tables.drop(former)
    return STAGES[-1][1](spark, docs, sf_dir)
