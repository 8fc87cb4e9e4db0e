"""Token ids as Parquet list columns, with encodings, row groups and page indexes under control.

Documents are dealt by ranges of doc_id, encoded, and written in ascending order: the list column dictionary encoded
(token ids repeat), the id column delta encoded (it ascends). The writer adds column and offset indexes, and small pages
make them selective: a reader that wants a few documents or only the metadata fetches only those pages.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, in_chunks, process_cache, rows_a_batch, tidy

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Characters of a text that count when rows of one id are dealt to tasks.
DEALT_CHARS = 256
#: Most words, and most bytes of words and their ids, that a process remembers before it starts anew; most characters in one
#: call of the encoder.
MAX_WORDS = 1_100_000
MAX_TABLE_BYTES = 128 << 20
MAX_WORD_BYTES = 4096
CHUNK_CHARS = 1_200_000
BYTE_SPACE = "Ġ"  # how a byte-level vocabulary writes a space
_NO_SPACE = "\x01"
_BETWEEN = "\x02"
_MARK = " " + _NO_SPACE
_MARK_AFTER_OTHER = re.compile(r"[.,](?<![^\W\d_][.,])").search
_SPACE_AFTER_SPACE = re.compile(r"\s ").search


def _tails_apart(text: str) -> str:
    """A space and _NO_SPACE before each comma and full stop, if all of them follow a letter and so begin a token. The text must not hold _NO_SPACE."""
    if _MARK_AFTER_OTHER(text):
        return text
    return text.replace(",", _MARK + ",").replace(".", _MARK + ".")


def _equal_words(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each sizes[k] bytes of a from at[k] equal those of b from bt[k]."""
    out, some = np.ones(len(sizes), bool), np.flatnonzero(sizes)
    if len(some):
        n = sizes[some]
        first = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(first, n)
        out[some] = np.logical_and.reduceat(a[np.repeat(at[some], n) + inside] == b[np.repeat(bt[some], n) + inside], first)
    return out


class WordTable:
    """Ids of words, found by a hash of the word in a sorted array and told apart by the word's own bytes."""

    def __init__(self):
        self.keys = np.zeros(0, "u8")
        self.starts, self.widths, self.places, self.sizes = (np.zeros(0, "i4") for _ in range(4))
        self.pool, self.used = np.zeros(1 << 16, "u4"), 0
        self.letters, self.written = np.zeros(1 << 16, "u1"), 0

    def add(self, data: bytes) -> int:
        """Ids at the end of the pool; returns where."""
        ids, at = np.frombuffer(data, "<u4"), self.used
        if at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(len(self.pool), len(ids)), "u4")])
        self.pool[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def find(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word (sizes bytes of raw from starts) is known, and its place and number of ids."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), "i4"), np.zeros(len(keys), "i4")
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = (self.keys[at] == keys) & (self.sizes[at] == sizes)
        some = np.flatnonzero(hit)
        hit[some] = _equal_words(raw, starts[some], self.letters, self.places[at[some]], sizes[some])
        return hit, self.starts[at], self.widths[at]

    def insert(self, keys: np.ndarray, starts: np.ndarray, widths: np.ndarray, words: list[bytes]) -> None:
        if not len(keys):
            return
        data, sizes = b"".join(words), np.fromiter(map(len, words), "i4", len(words))
        if self.written + len(data) > len(self.letters):
            self.letters = np.concatenate([self.letters[: self.written], np.zeros(max(len(self.letters), len(data)), "u1")])
        self.letters[self.written : self.written + len(data)] = np.frombuffer(data, "u1")
        places = self.written + np.cumsum(sizes, dtype="i4") - sizes
        self.written += len(data)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        if len(self.keys):  # a word whose key another word has is learned anew each time
            free = self.keys[np.minimum(at, len(self.keys) - 1)] != keys[order]
            order, at = order[free], at[free]
        for name, new in (("keys", keys), ("starts", starts), ("widths", widths), ("places", places), ("sizes", sizes)):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))


_FACTORS = np.random.default_rng(77).integers(1, 1 << 63, MAX_WORD_BYTES, "u8") | np.uint64(1)


class WordEncoder:
    """Encodes with a tokenizers file, exactly as encode(text, add_special_tokens=False) would.

    A byte-level splitter never lets a token cross from a non-space into the space that follows, so a text falls apart at
    every single space between words, and each word with its space is encoded once and remembered. New words are encoded
    many at a time, one after the other in one string, where each word's first token begins with its space. Texts where a
    space follows white space, or a word is very long, are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[k for token, k in vocabulary.items() if token.startswith(BYTE_SPACE)]] = True
        self.splitter = self.tokenizer.pre_tokenizer
        by_space = pre_tokenizers.Split(" ", "merged_with_next")
        self.letters = pre_tokenizers.Sequence([by_space, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words = WordTable()

    def _ids(self, texts: list[str], splitter=None) -> list[np.ndarray]:
        self.tokenizer.pre_tokenizer = splitter or self.splitter
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of each word with a space before it, or without for those marked so. Words of letters alone are one token
        of the splitter, so `self.letters` need not look for others in them."""
        out: list[bytes] = [b""] * len(new)
        plain = [k for k, word in enumerate(new) if word.isalpha()]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            groups = [part[k : k + 128] for k in range(0, len(part), 128)]
            for group, ids in zip(groups, self._ids([" " + " ".join([new[k] for k in g]) for g in groups], self.letters)):
                opens = np.flatnonzero(self.opens[ids])
                if len(opens) == len(group):
                    data, edges = ids.tobytes(), [*(opens * 4).tolist(), ids.nbytes]
                    for k, a, b in zip(group, edges, edges[1:]):
                        out[k] = data[a:b]
                else:
                    for k, own in zip(group, self._ids([" " + new[k] for k in group])):
                        out[k] = own.tobytes()
        rest = [k for k, word in enumerate(new) if not word.isalpha()]
        for k, ids in zip(rest, self._ids([new[k][1:] if new[k][:1] == _NO_SPACE else " " + new[k] for k in rest])):
            out[k] = ids.tobytes()
        return out

    def encode(self, texts: list[str], whole: frozenset = frozenset()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of ids of each. Those numbered in `whole` aren't split.

        Words are hashed all at once; only a chunk's distinct words that the table doesn't hold are looked at here, and the
        ids of all words are gathered at once. A text's first word, which has no space before it, is a word of its own.
        Words of one hash are compared byte by byte; where they differ, their texts are encoded whole.
        """
        if len(self.words.keys) > MAX_WORDS or self.words.written + 4 * self.words.used > MAX_TABLE_BYTES:
            self.words = WordTable()
        table = self.words
        alone = [k in whole or text[:1] == " " or _NO_SPACE in text or _BETWEEN in text or _SPACE_AFTER_SPACE(text) is not None for k, text in enumerate(texts)]
        apart = ["" if x else _tails_apart(text) for x, text in zip(alone, texts)]
        for k in [k for k, text in enumerate(apart) if len(text) > MAX_WORD_BYTES // 4 and max(map(len, text.split(" "))) > MAX_WORD_BYTES // 4]:
            alone[k], apart[k] = True, ""
        blob = _BETWEEN.join([*apart, ""]).encode()  # each word is followed by a space or by _BETWEEN
        raw = np.frombuffer(blob, "u1")
        ends = np.flatnonzero((raw == 32) | (raw == ord(_BETWEEN)))
        starts = np.append(0, ends[:-1] + 1)
        sizes = (ends - starts).astype("i4")
        place = np.arange(len(raw)) - np.repeat(starts, sizes + 1)
        value = raw.astype("u8") + np.uint64(1)
        value[ends] = 0
        keys = np.add.reduceat(value * _FACTORS[place], starts)
        keys ^= keys >> np.uint64(29)
        del value
        opens = np.append(0, np.flatnonzero(raw[ends] == ord(_BETWEEN))[:-1] + 1)  # first words of texts

        coded = pa.array(keys.view("i8")).dictionary_encode()
        index = coded.indices.to_numpy().copy()
        seen = np.empty(len(coded.dictionary), "i8")
        seen[index[::-1]] = np.arange(len(index))[::-1]
        place += np.repeat(starts[seen[index]], sizes + 1)
        differ = raw != raw.take(place, mode="clip")
        differ[ends] = False
        del place
        if (sizes != sizes[seen[index]]).any() or differ.any():
            words = np.flatnonzero((sizes != sizes[seen[index]]) | np.logical_or.reduceat(differ, starts))
            return self.encode(texts, whole | set((np.searchsorted(opens, words, side="right") - 1).tolist()))
        hit, at, width = table.find(keys[seen], raw, starts[seen], sizes[seen])
        at, width = at.copy(), width.copy()
        lost = np.flatnonzero(~hit)
        new = [blob[a:b] for a, b in zip(starts[seen[lost]].tolist(), ends[seen[lost]].tolist())]
        learned = self._learn([x.decode() for x in new])
        made = np.fromiter(map(len, learned), "i4", len(learned)) >> 2
        width[lost], at[lost] = made, table.add(b"".join(learned)) + np.cumsum(made, dtype="i4") - made
        table.insert(keys[seen[lost]], at[lost], made, new)

        firsts = self._ids([text if x else split.partition(" ")[0] for x, text, split in zip(alone, texts, apart)])
        own = np.fromiter(map(len, firsts), "i4", len(firsts))
        index[opens] = len(seen) + np.arange(len(texts))
        ids = np.concatenate([table.pool[: table.used], *firsts])
        at, width = np.append(at, table.used + np.cumsum(own, dtype="i4") - own), np.append(width, own)
        at, width = at[index], width[index]
        made = np.cumsum(width, dtype="i4")
        places = np.repeat(at - made + width, width)
        places += np.arange(len(places), dtype="i4")
        return ids[places], np.add.reduceat(width, opens)


def _encoder(path: str) -> WordEncoder:
    cache = process_cache()
    if ("words", path) not in cache:
        cache["words", path] = WordEncoder(path)
    return cache["words", path]


def encode_column(docs: DataFrame, model: str, end_id: int | None = END_ID) -> DataFrame:
    """doc_id and token_ids of each document; a null text is an empty one. end_id is appended where given."""

    def encode(batches):
        encoder = _encoder(model)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in in_chunks(texts, CHUNK_CHARS):
                ids, counts = encoder.encode(texts[part])
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                offsets, values = np.append(0, np.cumsum(counts)).astype("i4"), pa.array(ids.view("i4"))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "token_ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(encode), "doc_id long, token_ids array<int>")


def write_tokens(
    docs: DataFrame, model: str, path: str, end_id: int | None = END_ID, list_encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS
) -> None:
    """Write doc_id, n_tokens and token_ids in ascending order of doc_id (null first), file after file.

    list_encoding: "dictionary" or "delta" (binary packed). Rows that share a doc_id stand in the order of their texts, and are
    dealt by how their texts begin too, so an id (or none) with very many texts is several files' work.
    """
    if list_encoding not in ("dictionary", "delta"):
        raise ValueError(f"no such encoding: {list_encoding}")
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, DEALT_CHARS)).sortWithinPartitions("doc_id", "text")
    tokens = encode_column(dealt, model, end_id).select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids")
    dictionary = {"parquet.enable.dictionary": "false", "parquet.enable.dictionary#token_ids.list.element": str(list_encoding == "dictionary").lower()}
    sizes = {
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
        "parquet.dictionary.page.size": 1 << 20
    }
    with rows_a_batch(docs.sparkSession, BATCH_ROWS):  # what a task holds of texts at once
        tokens.write.options(**dictionary, **sizes).option("parquet.writer.version", "PARQUET_2_0").option("compression", "snappy").parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The written rows, those with low <= doc_id <= high where given; page indexes narrow what is read."""
    rows = spark.read.schema("doc_id long, n_tokens int, token_ids array<int>").parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def _file_order() -> list:
    """Files in the order written: by the numbers in their names, whatever their number of digits."""
    number = lambda pattern: F.regexp_extract("file", pattern, 1).try_cast("long").asc_nulls_first()
    return [number(r"part-(\d+)"), number(r"-c(\d+)"), F.col("file").asc()]


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens and ids_crc32, all from the files. Files are numbered in the
    order written; a running sum over files (few rows) and one within each file give the starts."""

    def sums(batches):
        import zlib

        for batch in batches:
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets).astype("i8")), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)],
                ["doc_id", "n_tokens", "ids_crc32", "file", "at"]
            )

    rows = read_tokens(spark, path).select("doc_id", "token_ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    rows = rows.mapInArrow(tidy(sums), "doc_id long, n_tokens long, ids_crc32 long, file string, at long")
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    files = read_tokens(spark, path).select("n_tokens", F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select(
        F.col("file").alias("in_file"),
        F.coalesce(F.sum("n").over(Window.orderBy(*_file_order()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead")
    )
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, F.col("file") == F.col("in_file")).select(
        "doc_id", (F.col("start") + F.col("ahead")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
