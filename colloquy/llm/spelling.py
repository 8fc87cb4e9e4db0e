"""Spelling variants: words of a corpus that differ by one letter, and the form that each of them most likely stands for.

Words are bytes of Latin-1, one for each code point. The vocabulary is dealt into shards of sorted words of one length, forwards
and backwards, and each shard becomes a minimal acyclic automaton whose paths number its words. Of a word with one error, the
first or the second half is right: the forward automata are entered with the first half and may err in the second, the backward
ones the other way round. A word goes only to the shards that can hold what it asks for. A pair is found once: from the longer
word, at the first place of a run of equal letters, or from the one with the smaller letter; both words are credited in the
task that finds it, so no row is made for a pair.
"""

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, in_chunks, tidy
from .scans import block_scan

#: A deletion where this divides the hash of a run; least code points and occurrences of a word.
DELETED_OF, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: Bytes of the words of a shard, and characters of texts counted at once.
SHARD_BYTES, CHARS_AT_ONCE = 1 << 19, 2_000_000
#: Shards are known by so many letters of their first and last words, words asked at once.
KNOWN_LETTERS, ASKED_AT_ONCE = 64, 20_000
#: Longest run whose hash is made from those of its document's name and of itself; longer ones are hashed whole.
SHORT_RUN = 64
FORWARD, BACKWARD = 0, 1

_LETTERS = bytearray(b" " * 256)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalpha():
        _LETTERS[_c] = ord(chr(_c).lower())
    elif _c >= 0xC0:
        _LETTERS[_c] = _c
_LETTERS = bytes(_LETTERS)
#: CRC-32's step for a byte 0 after each low byte of the state, without the inversions at both ends.
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = (_STEP >> np.uint32(1)) ^ np.where(_STEP & 1, np.uint32(0xEDB88320), np.uint32(0))


# Counting ------------------------------------------------------------------------------------------------------------


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def _shifted(states: np.ndarray, n: int) -> np.ndarray:
    """[k, i]: the part that hash i of what stands before has in the hash of both, when k bytes follow."""
    out = [states.astype(np.uint32)]
    for _ in range(n):
        out.append(_STEP[out[-1] & 0xFF] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


def _counted(prefixes: list[bytes], texts: list[str]) -> dict[bytes, int]:
    """Occurrences of the words of some documents."""
    runs, owners = [], []
    for text in texts:
        found = text.encode("latin-1", "replace").translate(_LETTERS).split()
        owners.append(len(found))
        runs += found
    if not runs:
        return {}
    encoded = pa.array(runs, pa.binary()).dictionary_encode()
    code, words = encoded.indices.to_numpy(), encoded.dictionary.to_pylist()
    owner = np.repeat(np.arange(len(texts)), owners)
    sizes = np.array([len(_utf8(w)) for w in words])
    own = np.array([zlib.crc32(_utf8(w)) for w in words], np.uint32)
    shifted = _shifted(np.array([zlib.crc32(p) for p in prefixes], np.uint32), min(SHORT_RUN, int(sizes.max())))
    hashes = shifted[np.minimum(sizes, SHORT_RUN)[code], owner] ^ own[code]
    for k in np.flatnonzero((sizes > SHORT_RUN)[code]):
        hashes[k] = zlib.crc32(_utf8(words[code[k]]), zlib.crc32(prefixes[owner[k]]))
    lengths = np.array([len(w) for w in words])
    hit = hashes % DELETED_OF == 0
    out: dict[bytes, int] = defaultdict(int)
    kept = np.bincount(code[~hit], minlength=len(words))
    for k in np.flatnonzero((kept > 0) & (lengths >= LEAST_LENGTH)):
        out[words[k]] += int(kept[k])
    for k, h in zip(code[hit].tolist(), hashes[hit].tolist()):
        if lengths[k] > LEAST_LENGTH:
            at = h % int(lengths[k])
            out[words[k][:at] + words[k][at + 1 :]] += 1
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """word and n of the words that stand at least 3 times in the documents' whole texts. Words are runs of A-Z, a-z and U+00C0 to
    U+00FF, A-Z as small letters, of 5 code points and more; where 97 divides the CRC-32 of `<doc_id>:<run>`, the run is without
    its code point at that number modulo its length. Null texts have no words, a null doc_id is written as nothing. Rows that are
    repeated count again; without rows there are no words. A task keeps the words of 2 million characters, which it sums."""

    def count(batches):
        for batch in batches:
            ids, texts = (["" if x is None else x for x in batch.column(k).to_pylist()] for k in (0, 1))
            for part in in_chunks(texts, CHARS_AT_ONCE):
                found = _counted([f"{i}:".encode() for i in ids[part]], texts[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
                )

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(tidy(count), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# Automata ------------------------------------------------------------------------------------------------------------


class Automaton:
    """The minimal acyclic automaton of sorted words of one length (rows of a matrix of letters). State s at depth d has the edges
    `keys[d]` from s * 256 on; an edge leads to `targets[d]` and skips `skipped[d]` words, so the numbers along a path add up to
    the word's place in the order."""

    def __init__(self, letters: np.ndarray):
        n, length = letters.shape
        fresh = np.zeros(n, np.int64)  # the depth from which a word has a path of its own
        if n > 1:
            fresh[1:] = (letters[1:] != letters[:-1]).argmax(1)
        self.keys, self.targets, self.skipped = [None] * length, [None] * length, [None] * length
        below, sizes = np.zeros(n, np.int64), np.ones(1, np.int64)  # states of the words' prefixes one deeper; words from each state on
        for depth in range(length - 1, -1, -1):
            starts = fresh <= depth  # a new edge from depth to depth + 1
            starts[0] = True
            nodes = fresh < depth
            nodes[0] = True
            at = np.flatnonzero(starts)
            parent = np.cumsum(nodes)[at] - 1
            target = below[at]
            edge = letters[at, depth].astype(np.int64) * len(sizes) + target
            first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            degree = np.diff(np.concatenate([first, [len(parent)]]))
            # nodes with equal edges are one state: compare edge after edge
            state = np.unique(edge[first], return_inverse=True)[1].astype(np.int64)
            for k in range(1, int(degree.max())):
                more = np.flatnonzero(degree > k)
                same = np.unique(state[more] * (256 * len(sizes)) + edge[first[more] + k], return_inverse=True)[1]
                state[more] = same + state.max() + 1
            kept, state = np.unique(state * 257 + degree, return_index=True, return_inverse=True)[1:]
            picked = np.repeat(first[kept], degree[kept]) + _ranges(degree[kept])
            owner = np.repeat(np.arange(len(kept)), degree[kept])
            held = sizes[target[picked]]
            before = np.cumsum(held) - held
            begins = np.cumsum(degree[kept]) - degree[kept]
            self.keys[depth] = owner * 256 + letters[at[picked], depth]
            self.targets[depth] = target[picked]
            self.skipped[depth] = before - before[begins][owner]
            sizes = np.bincount(owner, weights=held, minlength=len(kept)).astype(np.int64)
            below = state.astype(np.int64)[np.cumsum(nodes) - 1]

    def step(self, depth: int, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edge of each state by its letter, and which have one."""
        key = state * 256 + letter
        edge = np.minimum(np.searchsorted(self.keys[depth], key), len(self.keys[depth]) - 1)
        return edge, self.keys[depth][edge] == key

    def follow(self, depth: int, who: np.ndarray, state: np.ndarray, number: np.ndarray, asked: np.ndarray, column: int):
        """From a depth to the end by the letters of `asked` from a column on: who gets there, and with which number."""
        for d in range(depth, len(self.keys)):
            if not len(who):
                break
            edge, ok = self.step(d, state, asked[who, column + d - depth])
            edge, who, number = edge[ok], who[ok], number[ok]
            state, number = self.targets[d][edge], number + self.skipped[d][edge]
        return who, number

    def near(self, asked: np.ndarray, right: int, first_of_run: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of `asked` and the number of a word here that is like it but for one letter after the first `right` ones:
        replaced by a larger one if lengths are equal, or left out if the words here are one shorter; of equal letters in a row
        the first one counts (or the last one). Each pair comes once."""
        length, shorter = asked.shape[1], asked.shape[1] > len(self.keys)
        who = np.arange(len(asked))
        state, number = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        found = []
        for d in range(length):
            if d >= right:
                if shorter:
                    beside = d - 1 if first_of_run else d + 1
                    odd = np.ones(len(who), bool) if not 0 <= beside < length else asked[who, beside] != asked[who, d]
                    found.append(self.follow(d, who[odd], state[odd], number[odd], asked, d + 1))
                else:
                    lowest = np.searchsorted(self.keys[d], state * 256 + asked[who, d], "right")
                    ways = np.searchsorted(self.keys[d], state * 256 + 255, "right") - lowest
                    edge = np.repeat(lowest, ways) + _ranges(ways)
                    found.append(self.follow(d + 1, np.repeat(who, ways), self.targets[d][edge], np.repeat(number, ways) + self.skipped[d][edge], asked, d + 1))
            if d == len(self.keys) or not len(who):
                break
            edge, ok = self.step(d, state, asked[who, d])
            edge, who, number = edge[ok], who[ok], number[ok]
            state, number = self.targets[d][edge], number + self.skipped[d][edge]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (who[:0], number[:0])


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1 for each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _matrix(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


# Shards --------------------------------------------------------------------------------------------------------------


class _Routes:
    """Which shards a word has to ask. bounds: (way, length, shard, first word, last word), words cut to KNOWN_LETTERS."""

    def __init__(self, bounds: list[tuple[int, int, int, bytes, bytes]]):
        self.shards = defaultdict(lambda: ([], [], []))
        for way, length, shard, low, high in sorted(bounds, key=lambda b: b[:3]):
            for column, value in zip(self.shards[way, length], (shard, low, high)):
                column.append(value)
        self.letters = [bytes([c]) for c in range(ord("a"), 256) if bytes([c]).translate(_LETTERS) != b" "]

    def _span(self, key: tuple[int, int], prefix: bytes) -> tuple[int, int]:
        """The shards, from and before, that may hold a word that begins so."""
        _, lows, highs = self.shards[key]
        prefix = prefix[:KNOWN_LETTERS]
        return bisect_left(highs, prefix), bisect_right(lows, prefix + b"\xff" * (KNOWN_LETTERS - len(prefix)))

    def of(self, way: int, word: bytes, right: int, length: int) -> set[int]:
        """The shards of words of a length that may be like the word but for a letter after the first `right` ones. Where many
        shards begin with these, only those of the words that one error makes."""
        key = way, length
        if key not in self.shards:
            return set()
        numbers, out = self.shards[key][0], set()
        for at in range(right, len(word)):
            low, high = self._span(key, word[:at])
            if high - low <= 2:
                out.update(numbers[low:high])
                break
            for letter in [b""] if length < len(word) else self.letters:
                low, high = self._span(key, word[:at] + letter + word[at + 1 :])
                out.update(numbers[low:high])
        return out


def _asked(routes: "_Routes"):
    """Rows (way, len, shard, kind 1, word, n) for each shard that a word asks; backward ones are written backwards."""

    def ask(batches):
        names = ["way", "len", "shard", "kind", "word", "n"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
        for batch in batches:
            rows = []
            for word, n in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                word = word.encode("latin-1")
                half = len(word) // 2
                for way, letters, right in ((FORWARD, word, half), (BACKWARD, word[::-1], len(word) - half)):
                    for length in (len(word), len(word) - 1):
                        rows += [(way, length, shard, 1, letters, n) for shard in routes.of(way, letters, right, length)]
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return ask


class _Best:
    """For each of some words (by number): how many near words it has been credited with, and the best of them, that is the most
    frequent, then the smallest."""

    def __init__(self, size: int, length: int):
        self.count, self.n, self.word = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, f"S{length}")

    def credit(self, who: np.ndarray, n: np.ndarray, word: np.ndarray) -> None:
        if not len(who):
            return
        self.count += np.bincount(who, minlength=len(self.count))
        order = np.lexsort((word, -n, who))
        who, n, word = who[order], n[order], word[order]
        first = np.concatenate([[True], who[1:] != who[:-1]])
        who, n, word = who[first], n[first], word[first]
        better = (n > self.n[who]) | ((n == self.n[who]) & (word < self.word[who]))
        self.n[who[better]], self.word[who[better]] = n[better], word[better]

    def batch(self, words: np.ndarray) -> pa.RecordBatch:
        some = self.count > 0
        text = lambda x: pa.array([w.decode("latin-1") for w in x.tolist()], pa.string())
        return pa.RecordBatch.from_arrays(
            [text(words[some]), pa.array(self.count[some]), pa.array(self.n[some]), text(self.word[some])], ["word", "n_near", "best_n", "best"]
        )


def _strings(letters: np.ndarray, backwards: bool) -> np.ndarray:
    letters = np.ascontiguousarray(letters[:, ::-1] if backwards else letters)
    return letters.view(f"S{letters.shape[1]}").ravel()


def _met(batches):
    """Shards, each with its own words (kind 0, sorted) before those that ask it, to credits: word, n_near, best_n, best. A shard's
    own words are held while those that ask pass by."""
    key, held, asking = None, None, []

    def answer():
        by_length = defaultdict(list)
        for word, n in asking:
            by_length[len(word)].append((word, n))
        asking.clear()
        way, length = key[:2]
        for size, rows in by_length.items():
            letters, n = _matrix([w for w, _ in rows]), np.array([x for _, x in rows], np.int64)
            half = size // 2
            right = half if way == FORWARD else size - half
            who, number = held["automaton"].near(letters, right, way == FORWARD)
            words = _strings(letters, way == BACKWARD)
            own = _Best(len(rows), length)
            own.credit(who, held["n"][number], held["strings"][number])
            held["best"].credit(number, n[who], words[who])
            yield own.batch(words)

    def ready():
        letters = _matrix(held["words"])
        held.update(automaton=Automaton(letters), n=np.array(held["n"], np.int64), strings=_strings(letters, key[0] == BACKWARD))
        held["best"] = _Best(len(letters), key[1] + 1)

    def closed():
        if held is not None and "automaton" in held:
            yield from answer()
            yield held["best"].batch(held["strings"])

    for batch in batches:
        for *at, kind, word, n in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if at != key:
                yield from closed()
                key, held = at, {"words": [], "n": []}
            if kind == 0:
                held["words"].append(word)
                held["n"].append(n)
                continue
            if not held["words"]:
                continue
            if "automaton" not in held:
                ready()
            asking.append((word, n))
            if len(asking) == ASKED_AT_ONCE:
                yield from answer()
    yield from closed()


def near_words(words: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """word, n_near, best_n and best of each word (word, n; words are different, not null, of Latin-1 letters) that has near words:
    those that differ by exactly one inserted, deleted or replaced code point. best is the near word of the largest n, then the
    smallest in code-point order."""
    spark = words.sparkSession
    with Scratch(spark) as tables:
        words = tables.cut(words.select("word", "n"), "words")
        own, bounds = [], []
        for way in (FORWARD, BACKWARD):
            rows = words.select((F.col("word") if way == FORWARD else F.reverse("word")).alias("word"), F.length("word").alias("len"), "n")
            placed = block_scan(rows, "len", [F.col("word")], tables=tables)
            placed = tables.cut(placed.select(
                F.lit(way).alias("way"), "len", F.expr(f"(place - 1) * len div {shard_bytes}").alias("shard"), F.lit(0).alias("kind"), "word", "n"
            ), "shards")
            own.append(placed)
            low, high = (F.substring(f("word"), 1, KNOWN_LETTERS).alias(c) for f, c in ((F.min, "low"), (F.max, "high")))
            bounds += [(r.way, r["len"], r.shard, r.low.encode("latin-1"), r.high.encode("latin-1")) for r in placed.groupBy("way", "len", "shard").agg(low, high).collect()]
        asked = words.mapInArrow(_asked(_Routes(bounds)), "way int, len int, shard long, kind int, word binary, n long")
        latin = F.encode("word", "ISO-8859-1").alias("word")
        rows = asked.unionByName(own[0].unionByName(own[1]).select("way", "len", "shard", "kind", latin, "n"))
        met = rows.repartition("way", "len", "shard").sortWithinPartitions("way", "len", "shard", "kind", "word")
        credits = met.mapInArrow(tidy(_met), "word string, n_near long, best_n long, best string")
        best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
        found = credits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
        return cut(found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")), "near")


# Forms ---------------------------------------------------------------------------------------------------------------


def spelling_variants(words: DataFrame, ratio: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word (word, n). A word's form is its best near word if that is at least `ratio`
    times as frequent, else null; its root is the last word when forms are followed, itself if it has none. As frequency grows by
    `ratio` from form to form, chains are short, and they are followed by doubling. Without words there are no rows."""
    with Scratch(words.sparkSession) as tables:
        words = tables.cut(words.select("word", "n"), "words")
        near = near_words(words, shard_bytes)
        enough = F.col("best_n") >= ratio * F.col("n")
        rows = tables.cut(words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")
        ), "forms")
        roots = tables.cut(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
        moved = not roots.limit(1).isEmpty()
        while moved:
            on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            stepped = tables.cut(roots.join(on, "root", "left"), "roots")
            moved = not stepped.where("next is not null").limit(1).isEmpty()
            roots = stepped.select("word", F.coalesce("next", "root").alias("root"))
        out = rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return cut(out, "variants")
