"""Removal of repeated passages by sliding runs of sentences.

A text falls into pieces: sentences, and parts of PIECE_WORDS words of longer ones, so that text without marks has pieces
too. A run is the shortest stretch of consecutive pieces, forward from each piece and backward from each piece, with at
least RUN_PIECES pieces and RUN_WORDS words; short lines that many documents share stay. Runs are compared by 95-bit hashes
of their words, case and marks aside. Of equal runs the first, by doc_id and place, stays; pieces that any other one covers go.

Pieces of two copies have the same edges only if the copies start alike. So a text has anchors too: the stretches of
RUN_WORDS words whose hash is the least of RUN_WORDS neighbouring ones, wherever sentences start. Copies of 2 * RUN_WORDS - 1
words and more share an anchor at least: none escapes. A repeated anchor goes with the equal words on both sides of it, up to
RUN_WORDS - 1 of them, as the first document that holds the anchor has them; a longer copy has further anchors. One part
stays: where parts of a long sentence go as pieces and the copy ends inside its next part, the words of that part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, cut, tidy
from .words import find_words
from .words import mix as _mix

RUN_PIECES = 3
RUN_WORDS = 25
PIECE_WORDS = 16
FILTER_BITS = 1 << 24
_U = np.uint64
_ROLL = _U(0x9E3779B97F4A7C15)
_ANCHOR = _U(0xA0761D6478BD642F)


class Pieces:
    """The pieces of one text: places of their first words, hashes of the runs that start and end at them, and the anchors.

    h2 is even for runs and odd for anchors; tags are short hashes of the words."""

    def __init__(self, text: str):
        code = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
        if len(code) != len(text):  # a letter whose lower case is longer; its first code point stands for it
            text = "".join(c if len(c.lower()) == 1 else c.lower()[0] for c in text)
            code = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
        space = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 0xA0) | (code == 0x3000)
        first, hashed = find_words(code)
        self.words, self.bounds, self.tags = first, np.zeros(1, "i8"), np.zeros(0, "<u4")
        self.opens = np.zeros(0, "i8")  # first words of sentences
        self.runs, self.anchors = np.zeros((0, 2), "i8"), np.zeros(0, "i8")
        self.h1, self.h2, self.a1, self.a2 = (np.zeros(0, "u8") for _ in range(4))
        if not len(first):
            return
        stop = (code == 46) | (code == 33) | (code == 63) | (code == 0x3002) | (code == 0x2026)
        stop &= np.append(space[1:], True)
        if code.max() >= 0x3000:
            stop |= (code == 0x3002) | (code == 0xFF01) | (code == 0xFF1F)
        ends = np.flatnonzero(stop | (code == 10))
        sentence = np.searchsorted(ends, first)  # of each word
        self.opens = opens = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        place = np.arange(len(first)) - opens[np.cumsum(np.append(0, sentence[1:] != sentence[:-1]))]
        at = np.flatnonzero(place % PIECE_WORDS == 0)  # first words of pieces
        self.bounds = bounds = np.append(at, len(first))  # in words
        self.tags = (hashed >> _U(32)).astype("<u4")
        n = len(at)

        power, sums = _powers(len(first)), np.zeros(len(first) + 1, "u8")
        sums[1:] = np.cumsum(hashed * power)
        if len(first) >= 2 * RUN_WORDS - 1:
            rolled = (sums[RUN_WORDS:] - sums[:-RUN_WORDS]) * _powers(len(first) - RUN_WORDS + 1, True)
            order = _mix(rolled ^ _ANCHOR)
            least = _least(order)
            edge = np.zeros(RUN_WORDS - 1, "u8")
            self.anchors = np.flatnonzero(~_least(~np.concatenate([edge, least, edge])) == order)
            self.a1 = order[self.anchors]
            self.a2 = _mix(rolled[self.anchors] ^ _ROLL) >> _U(32) | _U(1)
        low = np.searchsorted(bounds, bounds[:-1] + RUN_WORDS, side="left")
        low = np.maximum(low, np.arange(n) + RUN_PIECES)  # forward runs end before this piece
        forward = np.stack([np.arange(n), low], axis=1)[low <= n]
        high = np.searchsorted(bounds, bounds[1:] - RUN_WORDS, side="right") - 1
        high = np.minimum(high, np.arange(n) + 1 - RUN_PIECES)
        backward = np.stack([high, np.arange(n) + 1], axis=1)[high >= 0]
        runs = np.concatenate([forward, backward])
        if not len(runs):
            return
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        self.runs = runs[np.append(True, (runs[1:] != runs[:-1]).any(1))]
        a, b = bounds[self.runs[:, 0]], bounds[self.runs[:, 1]]
        rolled = (sums[b] - sums[a]) * _powers(len(first), True)[a]
        self.h1 = _mix(rolled + (b - a).astype("u8"))
        self.h2 = _mix(rolled ^ _ROLL) >> _U(32) & ~_U(1)

    def run_keys(self) -> list:
        return _keys(self.h1, self.h2)

    def anchor_keys(self) -> list:
        return _keys(self.a1, self.a2)

    def around(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Tags of the words before an anchor, backward, and after it."""
        return self.tags[max(0, p - RUN_WORDS + 1) : p][::-1], self.tags[p + RUN_WORDS : p + 2 * RUN_WORDS - 1]


def _keys(h1: np.ndarray, h2: np.ndarray) -> list:
    return list(zip(h1.view("i8").tolist(), h2.astype("u4").view("i4").tolist()))


def _least(x: np.ndarray) -> np.ndarray:
    """The least of each RUN_WORDS consecutive values."""
    out, width = x, 1
    while width < RUN_WORDS:
        step = min(width, RUN_WORDS - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many values are equal from the start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


_INVERSE = _U(pow(int(_ROLL), -1, 1 << 64))
_TABLES = {False: np.ones(1, "u8"), True: np.ones(1, "u8")}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers of an odd number modulo 2**64, or of its inverse; a hash shifted by the place where it starts."""
    if len(_TABLES[inverse]) < n + 1:
        _TABLES[inverse] = np.append(_U(1), np.multiply.accumulate(np.full(max(n, 4096), _INVERSE if inverse else _ROLL, "u8")))
    return _TABLES[inverse][:n]


#: In place of a run: the document repeats something of its own.
_OWN = 0


def _id() -> Column:
    return F.col("doc_id").try_cast("long")


def _runs(docs: DataFrame) -> DataFrame:
    """id, h1, h2: each run and each anchor once a document, and once _OWN for documents that hold one of them twice."""

    def find(batches):
        for batch in batches:
            keys, h1, h2 = [np.zeros(0, "i8")], [np.zeros(0, "u8")], [np.zeros(0, "u8")]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces, twice = Pieces(text or ""), False
                for a, b in ((pieces.h1, pieces.h2), (pieces.a1, pieces.a2)):
                    if len(a):
                        _, at = np.unique(a, return_index=True)
                        twice |= len(at) < len(a)
                        keys.append(np.full(len(at), key, "i8"))
                        h1.append(a[at])
                        h2.append(b[at])
                if twice:
                    keys.append(np.array([key], "i8"))
                    h1.append(np.array([_OWN], "u8"))
                    h2.append(np.array([_OWN], "u8"))
            columns = np.concatenate(keys), np.concatenate(h1).view("i8"), np.concatenate(h2).astype("u4").view("i4")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "h1", "h2"])

    return docs.select(_id().alias("id"), "text").where("id is not null").mapInArrow(tidy(find), "id long, h1 long, h2 int")


def _among(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """doc_id and text of the rows whose hashed id has its bit set by some id, so of few that join nothing: a shuffle of
    all texts less. The bits take 2 MB at any size."""

    def slot(name):
        return F.pmod(F.xxhash64(F.col(name)), F.lit(FILTER_BITS))

    bits = ids.select(slot(column).alias("slot")).select(
        (F.col("slot") / 32).cast("int").alias("at"), F.expr("shiftleft(1L, cast(slot % 32 as int))").alias("bit")
    )
    bits = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, "u4")
    table[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def pick(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((sent.value[at >> 5] >> (at & 31).astype("u4")) & 1 == 1))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["doc_id", "text"])

    rows = docs.select(_id().alias("doc_id"), "text").where("doc_id is not null").select("doc_id", "text", slot("doc_id").alias("slot"))
    return rows.mapInArrow(tidy(pick), "doc_id long, text string")


def _contexts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """c1, c2, before, after: the tags of the words around each anchor, where the first document has it first."""
    firsts = firsts.where("g2 % 2 != 0")
    wanted = firsts.groupBy(F.col("first").alias("_first")).agg(F.collect_list(F.struct("g1", "g2")).alias("_wanted"))
    rows = _among(docs, firsts, "first").join(wanted, F.col("doc_id") == F.col("_first")).select("text", "_wanted")

    def find(batches):
        for batch in batches:
            out = [], [], [], []
            for text, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces, left = Pieces(text or ""), {(x["g1"], x["g2"]) for x in keys}
                for p, key in zip(pieces.anchors.tolist(), pieces.anchor_keys()):
                    if key in left:
                        left.remove(key)
                        for column, value in zip(out, (*key, *(x.tobytes() for x in pieces.around(p)))):
                            column.append(value)
            types = pa.int64(), pa.int32(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["c1", "c2", "before", "after"])

    return rows.mapInArrow(tidy(find), "c1 long, c2 int, before binary, after binary")


def _copied(pieces: Pieces, others: dict) -> np.ndarray:
    """Which words the repeated anchors and what is equal around them cover."""
    change, seen = np.zeros(len(pieces.words) + 1, "i8"), {}
    for p, key in zip(pieces.anchors.tolist(), pieces.anchor_keys()):
        q = seen.setdefault(key, p)
        if key not in others and p < q + RUN_WORDS:
            continue
        before, after = pieces.around(p)
        spans = [(_equal(before, np.frombuffer(x, "<u4")), _equal(after, np.frombuffer(y, "<u4"))) for x, y in others.get(key, ()) if x is not None]
        if p >= q + RUN_WORDS:  # the former one stays, so the two may not overlap
            x, y = pieces.around(q)
            left = min(_equal(before, x), p - q - RUN_WORDS)
            spans.append((left, min(_equal(after, y), p - left - q - RUN_WORDS)))
        for left, right in spans:
            change[p - left] += 1
            change[p + RUN_WORDS + right] -= 1
    return np.cumsum(change[:-1]) > 0


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype("i1"), [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


def kept_text(text: str, others: dict) -> tuple[str, list[tuple[int, int]]]:
    """The text without the words that go, and the spans of characters taken out. A run or an anchor goes if its hash is in
    `others` (it stands first in another document), or if it starts after the end of an equal one in the same text. The
    values of `others` are what stands before and after anchors there."""
    pieces = Pieces(text)
    if not others and all(len(np.unique(h)) == len(h) for h in (pieces.h1, pieces.a1)):
        return text, []
    gone, seen = np.zeros(len(pieces.words), bool), {}
    bounds = pieces.bounds
    for (a, b), key in zip(pieces.runs.tolist(), pieces.run_keys()):
        if key in others or a >= seen.setdefault(key, b):
            gone[bounds[a] : bounds[b]] = True
    whole = gone.copy()
    for a, b in _stretches(_copied(pieces, others)):
        end = a + int(np.flatnonzero(whole[a:b])[-1]) + 1 if whole[a:b].any() else a
        if a < end < b < bounds[np.searchsorted(bounds, end, side="right")] and end not in pieces.opens:
            b = end  # the copy ends inside the part after the last one that goes
        gone[a:b] = True
    edge = np.append(pieces.words, len(text))
    spans = [(int(edge[a]), int(edge[b])) for a, b in _stretches(gone)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]]), spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the text cut, and `removed` (spans of characters of the former text) and `n_removed` (their number) added;
    columns so named are replaced. Every row stays, a text that is repeated as a whole as an empty one; null texts stay null.

    Rows with the same doc_id count as one document. A row whose id is null, or no whole number, has no place in the order, so
    only what it repeats of itself goes. A text under RUN_PIECES pieces or RUN_WORDS words has no run and stays as it is.
    """
    docs = docs.drop("removed", "n_removed")
    with Scratch(docs.sparkSession) as tables:
        runs = tables.cut(_runs(docs), "runs")
        shared, own = runs.where(f"h1 <> {_OWN} or h2 <> {_OWN}"), runs.where(f"h1 = {_OWN} and h2 = {_OWN}")
        firsts = shared.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
        firsts = tables.cut(firsts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first"), "repeated")
        contexts = _contexts(docs, firsts)
        firsts = firsts.join(contexts, (F.col("g1") == F.col("c1")) & (F.col("g2") == F.col("c2")), "left").drop("c1", "c2")
        firsts = tables.cut(firsts, "around")  # both sides are tables, so a run of very many documents is split among tasks
        others = shared.join(
            firsts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
        ).where("id > first").select("id", "h1", "h2", "before", "after")
        none = F.lit(None).cast("binary")
        others = others.unionByName(own.select("id", "h1", "h2", none.alias("before"), none.alias("after")))
        others = others.groupBy(F.col("id").alias("_spans_of")).agg(F.collect_set(F.struct("h1", "h2", "before", "after")).alias("_spans"))
        others = cut(others, "spans")
    rows = docs.join(others, _id() == F.col("_spans_of"), "left").drop("_spans_of")
    names = docs.columns
    text_at, id_at = names.index("text"), names.index("doc_id")
    whole_ids = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(span)), T.StructField("n_removed", T.IntegerType())])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def clean(batches):
        for batch in batches:
            texts, removed, at = [], [], 0
            found = batch.column(len(names))
            h1, h2, before, after = found.flatten().flatten()
            found_all = list(zip(h1.to_numpy().tolist(), h2.to_numpy().tolist(), before.to_pylist(), after.to_pylist()))
            known = batch.column(id_at).is_valid().to_pylist() if whole_ids else [False] * batch.num_rows
            for text, n, has_id in zip(batch.column(text_at).to_pylist(), found.value_lengths().to_pylist(), known):
                others = {}
                if has_id and not n:  # nothing of it stands elsewhere before, or twice
                    texts.append(text)
                    removed.append([])
                    continue
                for a, b, *context in found_all[at : at + (n or 0)]:
                    others.setdefault((a, b), []).append(context)
                at += n or 0
                new, spans = kept_text(text, others) if text else (text, [])
                texts.append(new)
                removed.append([{"start": a, "end": b} for a, b in spans])
            columns = [*batch.columns[: len(names)], pa.array(removed, spans_type), pa.array([len(x) for x in removed], pa.int32())]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, "removed", "n_removed"])

    return rows.mapInArrow(tidy(clean), schema)
