"""Near duplicates by improved consistent weighted sampling over TF-IDF weighted word shingles.

Shingles are runs of five words. A shingle weighs (1 + ln tf) * idf. Document frequencies are counted over all documents in
a count-min sketch of fixed size, which resolves shares of documents down to about 1/1000 at any corpus size; idf runs
from 1 (in every document) to 1 + IDF_RANGE (rarer than that), a mild slope, because a steep one would put the members
of a large group of near copies below the threshold: what they share is frequent, where they differ is rare.

Samples of consistent weighted sampling agree with the probability of the weighted Jaccard similarity. Bands of samples
deal documents to buckets; members of a bucket are compared with its hub, and what that leaves apart in a bucket is
compared in blocks. Links are verified by exact weighted Jaccard similarity and joined to components. Exact copies (equal shingles and counts) are one document until the end.
"""

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_chunks, tidy
from .graph import connected_components
from .words import find_words
from .words import mix as _mix

WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 12, 4
SAMPLES = BANDS * BAND_ROWS
SKETCH_BITS = 20
SKETCH_BLOCK = 1 << 14
SKETCH_FAN = 16
RAREST = 1 / 1024
IDF_RANGE = 0.25
#: Members that one task compares with a leader before the leader is copied to another task.
MEMBERS_A_TASK = 256
#: Members of a bucket that one task compares with each other, or with another such block.
BLOCK_DOCUMENTS = 512
CHUNK_CHARS = 2_000_000
STEP = 256

_U = np.uint64
_PLACES = np.array([0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")
_random = np.random.default_rng(20240501)
_MULTIPLIERS = _random.integers(1, 1 << 32, (4, 1, SAMPLES), "u4") | np.uint32(1)
#: Quantiles of the gamma distribution with shape 2, for the step widths of the samples.
_draws = np.sort(_random.gamma(2.0, 1.0, 1 << 20))[(1 << 11) :: 1 << 12].astype("f4")
_BAND_MIX = _random.integers(1, 1 << 63, BAND_ROWS, "u8") | _U(1)


def shingles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingle hashes of each text in ascending order, and how often each occurs.

    Words are those of `words`: runs of letters and digits in lower case, and each Chinese or Japanese character. A text of
    one to four words is one shingle; a text without words has none.
    """
    lowered = [t.lower() for t in texts]
    first, words = find_words(np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), "<u4"))
    if not len(first):
        return [(np.zeros(0, "u8"), np.zeros(0, "i8"))] * len(texts)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    bounds = np.searchsorted(first, np.append(0, ends))
    rolled = reduce(np.add, (words[k : len(words) - WORDS + 1 + k] * _PLACES[k] for k in range(WORDS))) if len(words) >= WORDS else np.zeros(0, "u8")
    rolled = _mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if n >= WORDS:
            found = np.sort(rolled[a : b - WORDS + 1])
        elif n:
            found = _mix((words[a:b] * _PLACES[:n]).sum(keepdims=True) + _U(n))
        else:
            found = np.zeros(0, "u8")
        at = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, "i8")
        out.append((found[at], np.diff(np.append(at, len(found)))))
    return out


def _cells(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << SKETCH_BITS) - 1)
    return (found & mask).astype("i8"), ((found >> _U(SKETCH_BITS)) & mask).astype("i8")


def idf_tables(counts: np.ndarray, documents: int) -> np.ndarray:
    """The idf that each counter stands for, from document frequencies counted over the whole corpus in two rows."""
    counts = counts.astype("f8")
    noise = counts.sum(1, keepdims=True) / counts.shape[1]  # what other shingles add to a counter, on average
    share = np.clip(counts - noise, 0, None) / max(1, documents)
    slope = np.clip(np.log(np.maximum(share, RAREST) / RAREST) / np.log(1 / RAREST), 0, 1)
    return (1 + IDF_RANGE * (1 - slope)).astype("f4")


def weights(tables: np.ndarray, found: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(1 + ln tf) * idf; of a shingle's two counters the lower is nearer the truth, so the higher idf."""
    a, b = _cells(found)
    return (np.maximum(tables[0][a], tables[1][b]) * (1 + np.log(times))).astype("f4")


def count_shingles(docs: DataFrame) -> np.ndarray:
    """One pass over all documents. What comes to the driver are the counters, 8 MB for a corpus of any size."""

    def count(batches):
        counts, documents = np.zeros((2, 1 << SKETCH_BITS), "i4"), 0
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            documents += len(texts)
            for part in in_chunks(texts, CHUNK_CHARS):
                found = shingles(texts[part])
                for row, cells in zip(counts, _cells(np.concatenate([f for f, _ in found]))):
                    np.add.at(row, cells, 1)
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        some = [k for k in range(len(blocks)) if blocks[k].any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*some, -1], pa.int32()),
                pa.array([*(zlib.compress(blocks[k].astype("<i8").tobytes(), 1) for k in some), documents.to_bytes(8, "little")], pa.binary())
            ],
            ["block", "counts"]
        )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = np.frombuffer(data if block < 0 else zlib.decompress(data), "<i8")
                sums[block] = sums[block] + new if block in sums else new
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() if k < 0 else zlib.compress(x.tobytes(), 1) for k, x in sums.items()], pa.binary())],
            ["block", "counts"]
        )

    schema = "block int, counts binary"  # a block comes from many tasks, so each is summed in some tasks and then in one
    part = F.pmod(F.spark_partition_id(), F.lit(SKETCH_FAN))
    rows = docs.select("text").mapInArrow(tidy(count), schema).repartition("block", part).mapInArrow(tidy(add), schema).repartition("block").mapInArrow(tidy(add), schema).collect()
    counts, documents = np.zeros((2 << SKETCH_BITS) // SKETCH_BLOCK * SKETCH_BLOCK, "i8").reshape(-1, SKETCH_BLOCK), 0
    for row in rows:
        if row.block < 0:
            documents = int(np.frombuffer(row.counts, "<i8")[0])
        else:
            counts[row.block] = np.frombuffer(zlib.decompress(row.counts), "<i8")
    return idf_tables(counts.reshape(2, -1), documents)


def signature(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples: each a hash of the shingle drawn and of its quantised weight.

    For each shingle and sample: step width r (gamma 2), offset beta (uniform) and c (gamma 2) come from a hash of both;
    t = floor(ln w / r + beta), and the shingle with the least ln c - r (t - beta + 1) is drawn.
    """
    low, high = found.astype("u4")[:, None], (found >> _U(32)).astype("u4")[:, None]
    logs = np.log(weight)[:, None]
    best, drawn = np.full(SAMPLES, np.inf, "f4"), np.zeros(SAMPLES, "u8")
    columns = np.arange(SAMPLES)
    tiny, scale = np.float32(0.5), np.float32(2.0**-24)
    for k in range(0, len(found), STEP):
        lo, hi = low[k : k + STEP], high[k : k + STEP]
        x = lo * _MULTIPLIERS[0]
        x += hi * _MULTIPLIERS[1]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        y = hi * _MULTIPLIERS[2]
        y += lo * _MULTIPLIERS[3]
        y ^= y >> np.uint32(16)
        y *= np.uint32(0x297A2D39)
        y ^= y >> np.uint32(15)
        r = _draws[x & np.uint32(255)]
        beta = ((y & np.uint32(255)).astype("f4") + tiny) * np.float32(1 / 256)
        u = ((x >> np.uint32(8)).astype("f4") + tiny) * scale
        u *= ((y >> np.uint32(8)).astype("f4") + tiny) * scale
        np.log(u, out=u)
        np.negative(u, out=u)
        np.log(u, out=u)  # ln c
        t = np.floor(logs[k : k + STEP] / r + beta)
        u -= r * (t - beta + 1)
        at = u.argmin(0)
        least = u[at, columns]
        better = least < best
        best = np.where(better, least, best)
        drawn = np.where(better, _mix(found[k + at] ^ (t[at, columns].astype("i8").view("u8") * _U(0x9E3779B97F4A7C15))), drawn)
    return drawn


def band_hashes(drawn: np.ndarray) -> np.ndarray:
    return _mix((drawn.reshape(BANDS, BAND_ROWS) * _BAND_MIX).sum(1)).view("i8")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two vectors (ascending hashes, weights); 0 where either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = b[0][at] == a[0]
    x, y = a[1][shared].astype("f8"), b[1][at[shared]].astype("f8")
    least = np.minimum(x, y).sum()
    return float(least / (a[1].sum(dtype="f8") + b[1].sum(dtype="f8") - least))


def _signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, print (equal for documents of equal shingles and counts) and bands, of documents with an id and a word."""

    def sign(batches):
        tables = idf.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            kept, prints, bands = [], [], []
            for part in in_chunks(texts, CHUNK_CHARS):
                for key, (found, times) in zip(ids[part], shingles(texts[part])):
                    if len(found) and key is not None:
                        kept.append(key)
                        prints.append(hashlib.blake2b(found.tobytes() + times.astype("<i8").tobytes(), digest_size=16).digest())
                        bands.append(band_hashes(signature(found, weights(tables, found, times))))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, "i8"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype="i4") * BANDS), flat)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(prints, pa.binary()), lists], ["doc_id", "print", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(sign), "doc_id long, print binary, bands array<long>")


def _verify(pairs: DataFrame, docs: DataFrame, idf, threshold: float, cut) -> DataFrame:
    """pairs: member, leader. Adds linked. A leader's text goes to a task for every MEMBERS_A_TASK members, ahead of theirs."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS_A_TASK).cast("int").alias("salts"))
    salts = cut(salts, "salts")
    members = pairs.join(salts, "leader").select(
        F.col("member").alias("id"), "leader", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind")
    )
    leaders = salts.select(F.col("leader").alias("id"), "leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    asked = members.unionByName(leaders)
    rows = asked.join(docs.select(F.col("doc_id").alias("id"), "text"), "id").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind")

    def compare(batches):
        tables, at, vectors = idf.value, None, []
        for batch in batches:
            ids, leaders, salt, kinds, texts = (batch.column(k).to_pylist() for k in range(5))
            out = []
            for part in in_chunks([t or "" for t in texts], CHUNK_CHARS):
                chunk = [t or "" for t in texts[part]]
                for key, leader, s, kind, (found, times) in zip(ids[part], leaders[part], salt[part], kinds[part], shingles(chunk)):
                    vector = found, weights(tables, found, times)
                    if (leader, s) != at:
                        at, vectors = (leader, s), []
                    if kind == 0:
                        vectors.append(vector)
                    else:
                        out.append((key, leader, any(similarity(vector, v) >= threshold for v in vectors)))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], ["member", "leader", "linked"])

    found = rows.select("id", "leader", "salt", "kind", "text").mapInArrow(tidy(compare), "member long, leader long, linked boolean")
    return cut(found.groupBy("member", "leader").agg(F.max("linked").alias("linked")), "verified")


def _compare_buckets(rows: DataFrame, idf, threshold: float) -> DataFrame:
    """rows: band, hash, x, y, block, doc, component, bands, text; the first four name a part: one block of a bucket (x = y),
    or two, whose members are then compared with those of the other block only.
    Links (a, b) between documents of different components, each pair in the first band that both share."""
    rows = rows.repartition("band", "hash", "x", "y").sortWithinPartitions("band", "hash", "x", "y", "doc")

    def compare(batches):
        tables, state = idf.value, {"part": None, "docs": []}

        def links():
            docs, root, out = state["docs"], {}, []
            state["docs"] = []

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            if len(docs) > 1 and len({d[2] for d in docs}) > 1:
                bands = np.stack([d[3] for d in docs])
                blocks = np.array([d[1] for d in docs])
                totals = np.array([d[4][1].sum(dtype="f8") for d in docs])
                band, _, x, y = state["part"]
                apart = x != y
                for k in range(1, len(docs)):
                    first = (bands[:k] == bands[k]).argmax(1) == band
                    fair = np.minimum(totals[:k], totals[k]) >= threshold * np.maximum(totals[:k], totals[k])
                    if apart:
                        fair &= blocks[:k] != blocks[k]
                    for j in np.flatnonzero(first & fair):
                        x, y = find(docs[j][2]), find(docs[k][2])
                        if x != y and similarity(docs[j][4], docs[k][4]) >= threshold:
                            root[x] = y
                            out.append((docs[j][0], docs[k][0]))
            return out

        for batch in batches:
            *part, block, ids, components, bands, texts = (batch.column(k).to_pylist() for k in range(9))
            parts, out = list(zip(*part)), []
            for piece in in_chunks([t or "" for t in texts], CHUNK_CHARS):
                for n, (found, times) in zip(range(piece.start, piece.stop), shingles([t or "" for t in texts[piece]])):
                    if parts[n] != state["part"]:
                        out += links()
                        state["part"] = parts[n]
                    state["docs"].append((ids[n], block[n], components[n], np.array(bands[n], "i8"), (found, weights(tables, found, times))))
            yield _pairs(out)
        yield _pairs(links())

    def _pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows.select("band", "hash", "x", "y", "block", "doc", "component", "bands", "text").mapInArrow(tidy(compare), "a long, b long")


def near_duplicate_links(docs: DataFrame, threshold: float = THRESHOLD, tables: Scratch | None = None) -> DataFrame:
    """a, b: verified links and links of exact copies to the first of them; enough to join all classes. They are read from
    written tables, which go with `tables` where that is given.

    First each member of a bucket is compared with the bucket's hub: the member that meets most others in all its buckets,
    as the original of a group of edited copies does. What this joins is one component; buckets that still hold several
    are compared in blocks of BLOCK_DOCUMENTS, one component's members with another's, inside tasks. Of a bucket of m members
    with s outside its largest component, (2 m s - s * s) / BLOCK_DOCUMENTS rows are sent, and m at least.
    """
    cut = (tables or Scratch(docs.sparkSession)).cut
    idf = docs.sparkSession.sparkContext.broadcast(count_shingles(docs))
    signed = cut(_signatures(docs, idf), "signatures")
    firsts = cut(signed.groupBy("print").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")), "firsts")
    copies = signed.select("doc_id", "print").join(firsts.select(F.col("print").alias("p"), "first"), F.col("print") == F.col("p"))
    copies = copies.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))

    dealt = firsts.select(F.col("first").alias("doc"), F.posexplode("bands").alias("band", "hash"))
    sizes = cut(
        dealt.groupBy("band", "hash").agg(F.count("*").alias("size")).where("size > 1").select(
            F.col("band").alias("in_band"), F.col("hash").alias("in_hash"), "size"
        ),
        "sizes"
    )
    same_bucket = (F.col("band") == F.col("in_band")) & (F.col("hash") == F.col("in_hash"))
    members = cut(dealt.join(sizes, same_bucket).select("band", "hash", "doc", "size"), "members")
    meets = cut(members.groupBy(F.col("doc").alias("d")).agg(F.sum(F.col("size") - 1).alias("meets")), "meets")
    texts = cut(docs.select("doc_id", "text").join(meets.select("d"), F.col("doc_id") == F.col("d")).select("doc_id", "text"), "texts")

    hubs = members.join(meets, F.col("doc") == F.col("d")).groupBy("band", "hash").agg(F.max(F.struct("meets", (-F.col("doc")).alias("minus"))).alias("hub"))
    hubs = cut(hubs.select(F.col("band").alias("in_band"), F.col("hash").alias("in_hash"), (-F.col("hub.minus")).alias("leader")), "hubs")
    pairs = cut(members.join(hubs, same_bucket).where("doc <> leader").select(F.col("doc").alias("member"), "leader").distinct(), "pairs")
    linked = cut(_verify(pairs, texts, idf, threshold, cut).where("linked").select(F.col("leader").alias("a"), F.col("member").alias("b")), "linked")

    found = connected_components(linked)
    known = members.join(found, F.col("doc") == F.col("node"), "left").select("band", "hash", "doc", "size", F.coalesce("component", "doc").alias("component"))
    known = cut(known, "known")
    # A bucket's largest component is joined already, so its members meet the others only: these are dealt to `few` blocks
    # ahead of `many` of the largest component.
    parts = known.groupBy("band", "hash", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("band", "hash").agg(
        F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")
    ).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK_DOCUMENTS).cast("int")
    mixed = cut(
        mixed.select(
            F.col("band").alias("in_band"), F.col("hash").alias("in_hash"), F.col("top.component").alias("main"),
            blocks(F.col("all") - F.col("top.n")).alias("few"), blocks(F.col("top.n")).alias("many")
        ),
        "mixed"
    )
    own, apart = F.pmod(F.xxhash64("doc"), F.col("few")), F.col("few") + F.pmod(F.xxhash64("doc"), F.col("many"))
    in_main = F.col("component") == F.col("main")
    rest = known.join(mixed, same_bucket).withColumn("block", F.when(in_main, apart).otherwise(own).cast("int"))
    last = F.when(in_main, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    other = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(k, "block").alias("x"), F.greatest(k, "block").alias("y")))
    rest = rest.select("band", "hash", "doc", "component", "block", other.alias("others"))
    rest = rest.withColumn("pair", F.explode("others")).select("band", "hash", "doc", "component", "block", "pair.x", "pair.y")
    rest = rest.join(firsts.select(F.col("first").alias("f"), "bands"), F.col("doc") == F.col("f")).join(texts, F.col("doc") == F.col("doc_id"))
    more = cut(_compare_buckets(rest, idf, threshold), "more")
    return copies.unionByName(linked).unionByName(more)


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of each row of docs: the least doc_id of its class, its own where it has no near duplicate.

    Rows with the same doc_id are one document. A null id, and a text that is null or without words, links with nothing;
    a null id has a null class. An empty table gives an empty table.
    """
    with Scratch(docs.sparkSession) as tables:
        found = connected_components(near_duplicate_links(docs, threshold, tables))
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("class_id"))
