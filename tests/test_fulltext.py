"""The full-text operator against SQLite's FTS5, where this Python has it."""

import random
import sqlite3

import pytest

from colloquy.errors import QueryError
from colloquy.functions.porter import stem
from colloquy.operators import fulltext

WORDS = "kafka migration migrations migrating schema Café naïve the of a run running runner worthless test tests tested".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    return [None, "", *(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 25))) for _ in range(150))]


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, content string")


@pytest.fixture(scope="module")
def table(rows):
    return fulltext.token_table(rows).cache()


def _fts5(texts, tokenizer):
    db = sqlite3.connect(":memory:")
    try:
        db.execute(f"CREATE VIRTUAL TABLE f USING fts5(content, role UNINDEXED, tokenize='{tokenizer}')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    db.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(texts)))
    return db


@pytest.fixture(scope="module")
def sqlite(texts):
    return {True: _fts5(texts, "porter unicode61"), False: _fts5(texts, "unicode61 remove_diacritics 0")}


PATTERNS = [
    "kafka", "kafka schema", "kafka OR worthless", "kafka NOT the", '"of the"', "of + the", "worth*", "^kafka", "NEAR(kafka schema, 2)", "NEAR(kafka schema)", "cafe", "migrations",
    "content:kafka", "{content}:kafka", "- content:kafka", "(kafka OR schema) NOT (the AND of)", '"run" AND "tests"', "role:kafka", "kafka AND (the OR of)", "NEAR(the of run, 4)", "NEAR(the of, 100)", 'NEAR("of the" worth* kafka, 3)', "the* OR ^run",
]


@pytest.fixture(scope="module")
def postings(rows, table):
    words = fulltext.index(fulltext.token_table(rows, accents=False), ("id",)).cache()
    known = fulltext.stems_of(words.where("term < 'n'"))
    vocabulary = known.unionByName(fulltext.stems_of(words, known))
    return {True: fulltext.stemmed_index(words, vocabulary).cache(), False: fulltext.index(table, ("id",)).cache()}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_ranks_match(table, postings, texts, sqlite, pattern):
    sizes = len(texts), sum(len(fulltext.plain_tokens(t or "")) for t in texts)
    found = {
        (True, "index"): fulltext.search_index(postings[True], *sizes, pattern, 1000, ("id",)),
        (False, "index"): fulltext.search_index(postings[False], *sizes, pattern, 1000, ("id",), stemmed=False),
        (False, "tokens"): fulltext.search(table, pattern, 1000, ("id",), stemmed=False),
    }
    for (stemmed, _), rows in found.items():
        want = {k: r for k, r in sqlite[stemmed].execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (pattern,))}
        got = {r.id: r["rank"] for r in rows.collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_an_index_is_made_without_a_shuffle(spark, rows, table, postings, monkeypatch, at_once):
    """A row for each word of a text with its places in order, of words or stems, however many texts are taken at once."""
    monkeypatch.setattr(fulltext, "TOKENS_AT_ONCE", at_once)
    plain = {(w, r.id, len(r.tokens), tuple(k for k, t in enumerate(r.tokens) if t == w)) for r in table.collect() for w in r.tokens}
    found = fulltext.index(table, ("id",))
    stems = fulltext.index(fulltext.token_table(rows, accents=False), ("id",), stemmed=True)
    read = lambda df: [(r.term, r.id, r.n_tokens, tuple(r.places)) for r in df.collect()]
    assert len(read(found)) == len(plain) and set(read(found)) == plain
    assert sorted(read(stems)) == sorted(read(postings[True]))
    uncached = fulltext.token_table(rows.coalesce(1))
    run = [r[0] for r in read(fulltext.index(uncached, ("id",)))]
    assert at_once < 1 << 20 or run == sorted(run)
    assert "Exchange" not in fulltext.index(uncached, ("id",), stemmed=True)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_entered_by_rare_words():
    often = {("the", False): 900, ("of", False): 800, ("kafka", False): 3, ("schema", False): 5, ("w", True): 2}
    entries = lambda pattern: {w for w, _ in fulltext._entries(fulltext.parse(pattern, stemmed=False), often)}
    assert entries("the kafka") == {"kafka"} and entries("the OR kafka") == {"the", "kafka"} and entries('"the schema" of') == {"schema"}
    assert entries("schema NOT kafka") == {"schema"} and entries("NEAR(the of kafka)") == {"kafka"} and entries("(kafka OR schema) AND the AND of") == {"kafka", "schema"}
    assert entries("the w*") == {"w"} and entries("role:the") == set()


@pytest.mark.parametrize("pattern", ["", "Kafka's", "C++", "a.b", "foo-bar", "AND", "a AND", '"open', "(a", "NEAR(a b, x)", "nocolumn:a"])
def test_patterns_outside_the_grammar(pattern):
    with pytest.raises(QueryError):
        fulltext.parse(pattern)


def test_limit_and_order(table):
    found = [(r["rank"], r.id) for r in fulltext.search(table, "the", 5, ("id",), stemmed=False).collect()]
    assert len(found) == 5 and found == sorted(found)


def test_stems():
    pairs = {
        "caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "conflated": "conflat",
        "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "digitizer": "digit", "triplicate": "triplic", "hopeful": "hope",
        "revival": "reviv", "adoption": "adopt", "probate": "probat", "controll": "control", "roll": "roll", "sky": "sky", "is": "is"
    }
    assert {w: stem(w) for w in pairs} == pairs
