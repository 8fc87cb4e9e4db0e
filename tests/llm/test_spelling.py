"""Spelling variants against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import queries, spelling
from tests.llm.conftest import DOC


def plain_words(docs):
    out = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def plain_variants(words):
    out = {}
    for w, n in words.items():
        others = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        form = others[0] if others and words[others[0]] >= 2 * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (row[0], root, *row[1:])
    return out


def variants(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: tuple(r)[1:] for r in rows}


def random_words(rng, n, letters, least, most):
    return {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))): rng.randint(3, 60) for _ in range(n)}


@pytest.mark.parametrize("letters,least,most,shard", [("ab", 5, 9, 1 << 19), ("abéÿ", 5, 7, 60), ("xyz", 5, 8, 7), ("a", 5, 40, 100)])
def test_all_near_words_are_found_in_shards_of_any_size(spark, rng, letters, least, most, shard):
    words = random_words(rng, 300, letters, least, most)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert variants(spelling.spelling_variants(df, shard_bytes=shard)) == plain_variants(words)


def test_words_that_share_a_half(spark, rng):
    """Many shards of words that begin, or end, alike, which a word's first or second half can't tell apart."""
    words = {f"{a}{m}{z}": rng.randint(3, 90) for a, z in (("samebeginning", ""), ("", "sameending"), ("both", "sides")) for m in random_words(rng, 120, "abc", 1, 5)}
    words |= {"z" * 300: 5, "z" * 301: 11, "z" * 299 + "y": 6, "z" * 150 + "y" + "z" * 150: 3}
    words = {w: n for w, n in words.items() if len(w) >= 5}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert variants(spelling.spelling_variants(df, shard_bytes=50)) == plain_variants(words)


def test_words_are_numbered_by_their_order(rng):
    words = sorted(w.encode() for w in random_words(rng, 400, "abcd", 7, 7))
    letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)
    automaton = spelling.Automaton(letters)
    zero = np.zeros(len(words), np.int64)
    who, number = automaton.follow(0, np.arange(len(words)), zero, zero, letters, 0)
    assert who.tolist() == number.tolist() == list(range(len(words)))
    missing = np.frombuffer(b"".join(w[:6] + b"e" for w in words), np.uint8).reshape(len(words), -1)
    assert not len(automaton.follow(0, np.arange(len(words)), zero, zero, missing, 0)[0])
    states = sum(len(set((k >> 8).tolist())) for k in automaton.keys)
    assert states < sum(len({w[:d] for w in words}) for d in range(7))  # equal ends are shared


def test_equal_ends_are_one_state():
    words = sorted(a + z for a in (b"one", b"two", b"six") for z in (b"ing", b"est"))
    automaton = spelling.Automaton(np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1))
    assert [len(set((k >> 8).tolist())) for k in automaton.keys] == [1, 3, 3, 1, 2, 2]


def test_words_of_documents(spark, rng):
    letters = "abcDEFÀéÿ×"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(80)) for _ in range(60)]
    texts += [None, "", "12 ,;", "x" * 5000 + " " + "y" * 64 + " " + "z" * 65, "Wörter, words; WORDSĀwords Αwords wörter"] * 4
    docs = [(None if k % 17 == 0 else k, t) for k, t in enumerate(texts)]
    docs += docs[:5]  # repeated rows
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in docs], DOC).withColumnRenamed("lang", "word").withColumnRenamed("n_chars", "n")
    got = {r.word: r.n for r in spelling.count_words(df.repartition(4)).collect()}
    assert got == plain_words(docs) and "x" * 5000 in got


def test_the_spelling_query(spark, rng, tmp_path, documents):
    vocabulary = list(random_words(rng, 60, "abc", 4, 6))
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(40)]
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert variants(queries.op12_spelling(spark, str(tmp_path))) == plain_variants(plain_words(docs))


def test_no_words(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op12_spelling(spark, str(tmp_path)).count() == 0
