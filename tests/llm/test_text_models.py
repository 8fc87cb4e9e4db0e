import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import language_id, quality, toxicity
from colloquy.llm.common import id_crc, labelled_sample

from .conftest import sentences, words


def lexicon():
    rng, rows = random.Random(1), []
    for k in range(600):
        text, toxic = words(rng, 40), k % 5 == 0
        rows.append((text + (" idiot scum" if toxic else " trash collection") + " " + words(rng, 5) + (" trash" if toxic else ""), int(toxic)))
    return toxicity.learn_lexicon(rows)


def test_lexicon_finds_words_folds_and_spares_exceptions():
    known = lexicon()
    score = lambda t: float(known.score(np.array([known.features(known.automaton(), t)]))[0])
    rest = words(random.Random(2), 40)
    assert {"idiot", "scum"} <= set(known.entries)
    assert score(f"{rest} idiot scum") > 0.5
    assert score(f"{rest} 1D10T scum") > 0.5  # digits for letters
    assert score(f"{rest} іdіоt sсum") > 0.5  # Cyrillic letters
    assert score(f"{rest} idiotic scumble") == score(rest) < 0.5  # other words
    assert score("") < 0.5 and score(None) < 0.5


def test_exception_phrases_do_not_count():
    known = toxicity.Lexicon({"trash": 3.0}, ["trash collection"])
    assert known.hits(known.automaton(), "the trash collection") == []
    assert known.hits(known.automaton(), "the trash is") == [3.0]


def test_length_lowers_the_density():
    known = lexicon()
    short, long = known.features(known.automaton(), "idiot"), known.features(known.automaton(), "idiot " + "word " * 1000)
    assert short[0] > long[0] and short[1] == long[1]


def test_prefixes_stand_for_many_words():
    rng, rows = random.Random(3), []
    for k in range(800):
        toxic = k % 4 == 0
        rows.append((words(rng, 30) + (" zurk" + words(rng, 1) if toxic else ""), int(toxic)))
    known = toxicity.learn_lexicon(rows)
    assert any(e.startswith("zurk"[: len(e) - 1]) and e.endswith("*") for e in known.entries)
    assert float(known.score(np.array([known.features(known.automaton(), "anon zurkneverseen bleti")]))[0]) > 0.5


def test_scores_of_a_table_with_nulls_and_repeats(spark, documents, empty):
    known = lexicon()
    docs = documents([(1, "you idiot scum"), (1, "you idiot scum"), (2, None), (None, ""), (3, "x" * 300_000)]).withColumn("tox_score", F.lit("clash"))
    rows = toxicity.toxicity_scores(docs, known).collect()
    assert len(rows) == 5 and sum(r.tox_score > 0.5 for r in rows) == 2
    assert toxicity.toxicity_scores(empty, known).count() == 0
    assert toxicity.learn_lexicon([]).entries == {} and toxicity.learn_lexicon([("a", 1)]).entries == {}


def test_labelled_sample_keeps_to_usable_rows(spark, documents):
    docs = documents([(k, f"text {k}") for k in range(100)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(100)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    rows = labelled_sample(docs, labels, "toxic", id_crc("doc_id") % 5 != 0, limit=30).collect()
    assert len(rows) == 30 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows) and all(r.y == r.doc_id % 2 for r in rows)


def test_samples_are_bounded_by_rows_and_characters(spark, documents):
    from colloquy.llm.common import bounded_rows

    docs = documents([(1, f"text {k:05}") for k in range(500)] + [(k, "x" * 5000) for k in range(2, 40)] + [(1, "text 00000")] * 50)
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, toxic int")
    anything = id_crc("doc_id") >= 0
    assert labelled_sample(docs, labels, "toxic", anything, limit=1).count() == 1
    assert labelled_sample(docs, labels, "toxic", anything, limit=45).count() == 45
    rows = labelled_sample(docs, labels, "toxic", anything, limit=1000, chars=12_000).collect()
    assert 0 < sum(len(r.text) for r in rows) <= 12_000
    assert {tuple(r) for r in rows} == {tuple(r) for r in labelled_sample(docs.repartition(7), labels, "toxic", anything, limit=1000, chars=12_000).collect()}
    assert {r.doc_id for r in labelled_sample(docs, labels, "toxic", anything, limit=1000, chars=4999).collect()} <= {1}
    languages = spark.createDataFrame([(1, "a b", "en"), (1, "c d", "fr"), (1, "c d", "fr"), (2, None, "en")], "doc_id long, text string, lang string")
    assert sorted((r.doc_id, r.text or "", r.lang) for r in bounded_rows(languages, 10, 100).collect()) == [(1, "a b", "en"), (1, "c d", "fr"), (2, "", "en")]


ALPHABETS = {"en": "theandingof", "de": "dieschungü", "fr": "lesêtreéaux", "es": "ciónlosñado", "xx": "qqzzkkvvjj"}


def phrase(rng, lang, n=60):
    letters = ALPHABETS[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_languages_by_family_and_pair(spark, documents, empty):
    rng = random.Random(4)
    model = language_id.learn_languages([(phrase(rng, lang), lang) for lang in ALPHABETS for _ in range(60)])
    assert model.members["germanic"] == ["de", "en"] and model.members["romance"] == ["es", "fr"] and model.members["xx"] == ["xx"]
    assert set(model.pair_weights) == {("de", "en"), ("es", "fr")}
    held = [(lang, phrase(rng, lang)) for lang in ALPHABETS for _ in range(30)]
    names, scores = model.predict([t for _, t in held])
    assert np.mean([a == b for a, (b, _) in zip(names, held)]) > 0.97 and all(0 <= s <= 1 for s in scores)
    docs = documents([(1, None), (2, ""), (3, "12 + 3 = !"), (None, phrase(rng, "fr")), (4, phrase(rng, "de") * 500)])
    found = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.predict_languages(docs, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[None][0] == "fr" and found[4][0] == "de"
    assert language_id.predict_languages(empty, model).count() == 0
    assert language_id.learn_languages([]).predict(["abc"]) == (["und"], [0.0])


def test_rules_are_columns_and_tell_junk_from_prose(spark, documents, empty):
    rng = random.Random(6)
    make = lambda good: sentences(rng, 12) if good else rng.choice(
        [" ".join([words(rng, 1)] * 60), words(rng, 50).upper().replace(" ", "!! "), words(rng, 40).replace(" ", " | ")]
    )
    texts = [(make(k % 3 > 0), int(k % 3 > 0)) for k in range(600)]
    x, y = np.array([quality.statistics(t) for t, _ in texts]), np.array([y for _, y in texts], "f8")
    rules = quality.learn_rules(x[:400], y[:400])
    assert np.mean((rules.scores(x[400:]) >= 0.5) == y[400:]) > 0.97
    assert 0 < len(rules.rules) < 150 and all(1 <= len(r) <= 3 for r in rules.rules)
    docs = documents([(k, t) for k, (t, _) in enumerate(texts[400:])] + [(-1, None), (-2, ""), (-3, "a " * 100_000)])
    found = {r.doc_id: r.score for r in quality.text_statistics(docs).select("doc_id", rules.column().alias("score")).collect()}
    assert np.allclose([found[k] for k in range(200)], rules.scores(x[400:])) and all(0 <= found[k] <= 1 for k in (-1, -2, -3))
    assert quality.text_statistics(empty).count() == 0
    assert quality.learn_rules(np.zeros((0, len(quality.STATISTICS))), np.zeros(0)).rules == []
