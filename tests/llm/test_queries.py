"""The queries opN_<name> themselves, over small tables with odd rows, against plain versions of what they promise."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import language_id, minhash, queries, quality, toxicity

from .conftest import DOC, sentences, words
from .test_dedup import brute_links, components
from .test_mixing import fill

public_tokenizers = pytest.importorskip("public_tokenizers")
INSULTS = ("idiot", "scum", "moron", "worthless")
LANGUAGES = {"en": "theandingofto", "de": "dieschungüundei", "fr": "lesêtreéauxde", "es": "ciónlosñadoel"}


def prose(rng, lang, n):
    letters = LANGUAGES[lang]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


def crc(key) -> int:
    return zlib.crc32(str(key).encode())


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows, labels = random.Random(21), [], []
    for k in range(600):
        lang, toxic, bad = rng.choice([*LANGUAGES]), k % 5 == 0, k % 7 == 0
        text = prose(rng, lang, rng.randint(30, 80))
        if bad:
            text = " | ".join(text.split()).upper()
        if toxic:
            parts = text.split()
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(INSULTS))
            text = " ".join(parts)
        rows.append((k, text, lang, f"src{k % 4}", len(text)))
        if k % 3:
            labels.append((k, int(not bad), int(toxic)))
    base = sentences(rng, 12)
    rows += [(1000 + k, base + f" Ending {k}.", "en", "src1", 0) for k in range(5)] + [(1100, base, "en", "src1", 0), (1101, base, "en", "src1", 0)]
    odd = ["", None, "²", "½ Ⅷ ①", "12 + 3!", "x", "日本語 ☃ 🙂", "a" * 4000, "word " * 30_000, " \t\n ", "İstanbul. " * 40, "c\u0000d", "tail  space "]
    rows += [(2000 + k, text, None, None, None) for k, text in enumerate(odd)]
    rows += [
        (None, "No id at all.", "en", "src0", 1), (None, None, None, None, None), (7, rows[7][1], "en", "src3", 0),
        (7, "Another text under a used id.", "de", "src3", 0), (-5, "negative", "xx", "", 3)
    ]
    clash = [
        "score", "held_out", "predicted", "lang_pred", "class_id", "kept", "whole", "below", "size", "target", "taken", "media", "feature", "tokens", "removed",
        "node", "y", "known"
    ]
    where = str(tmp_path_factory.mktemp("queries"))
    docs = spark.createDataFrame(rows, DOC)
    docs.select("*", *[F.lit(f"own {c}").alias(c) for c in clash]).repartition(5).write.parquet(f"{where}/documents.parquet")
    labels += [(1, None, None), (None, 1, 1), (5, 0, 1), (999_999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    vectors = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(80)]
    vectors += [
        (100 + k, [x + rng.gauss(0, 0.05) for x in vectors[k % 9][1]]) for k in range(60)
    ] + [(300, vectors[0][1]), (301, [2 * x for x in vectors[0][1]])]
    odd_vectors = [
        (400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [float("-inf")] + [1.0] * 7), (405, [1.0] * 9),
        (406, []), (None, [1.0] * 8)
    ]
    made = spark.createDataFrame([(k, v, 1) for k, v in vectors + odd_vectors], "vec_id long, embedding array<double>, label int")
    made.withColumn("n_links", F.lit("own")).withColumn("first", F.lit(0)).write.parquet(f"{where}/embeddings.parquet")
    return {"where": where, "docs": rows, "vectors": vectors, "odd_vectors": odd_vectors}


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], DOC).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{where}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn int, role string, text string").write.parquet(f"{where}/conversations.parquet")
    return where


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables_give_empty_results(spark, nothing, name):
    rows = queries.queries()[name](spark, nothing).collect()
    assert [r.conv_id for r in rows] == [-1] if name == "op13_chat" else rows == []  # its own conversation is always there


def scored(spark, corpus, name, parts, rest):
    rows = queries.queries()[name](spark, corpus["where"]).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in corpus["docs"])
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id) % parts == rest) and 0 <= r.score <= 1 for r in rows)
    return rows


def test_op1_scores_by_a_naive_scan_of_the_lexicon(spark, corpus):
    rows = scored(spark, corpus, "op1_toxicity", 5, 0)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    held = [k for k in range(600) if crc(k) % 5 == 0 and k != 7]
    assert np.mean([by_id[k].predicted == (k % 5 == 0) for k in held]) > 0.97
    assert by_id[2000].score < 0.5 and by_id[2001].score == by_id[2000].score
    docs, labels = (spark.read.parquet(f"{corpus['where']}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = queries.learn_toxicity(docs, labels, queries.id_crc("doc_id") % 5 != 0)
    assert set(INSULTS) <= set(lexicon.entries)
    texts = {d[0]: d[1] for d in corpus["docs"] if d[0] not in (None, 7)}
    for key, text in texts.items():
        score = lexicon.score(np.array([naive_features(lexicon, text)]))[0]
        assert by_id[key].score == pytest.approx(float(score), abs=1e-12)


def naive_features(lexicon, text):
    """Every entry and phrase is looked for at every place by itself."""
    folded, at, spared = toxicity.fold(text or ""), {}, []
    edge = lambda k: k < 0 or k >= len(folded) or not folded[k].isalnum()
    for phrase in lexicon.exceptions:
        spared += [(k, k + len(phrase)) for k in range(len(folded)) if folded.startswith(phrase, k) and edge(k - 1) and edge(k + len(phrase))]
    for entry, weight in lexicon.entries.items():
        stem = entry.rstrip("*")
        for k in range(len(folded)):
            if folded.startswith(stem, k) and edge(k - 1) and (entry.endswith("*") or edge(k + len(stem))) and not any(a <= k < b for a, b in spared):
                at[k] = max(at.get(k, 0), weight)
    total = sum(at.values())
    return 100 * total / (20 + len(folded.split())), np.log1p(total)


def test_hits_match_a_naive_scan_where_phrases_overlap():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({"ab": 1.0, "abc": 2.0, "b*": 0.5, "ca": 4.0}, ["ab ca", "ca ab", "b b", "ab", "abc ca b"])
    automaton = lexicon.automaton()
    for _ in range(400):
        text = "".join(rng.choice("abc  ") for _ in range(24))
        assert lexicon.features(automaton, text) == pytest.approx(naive_features(lexicon, text))


def test_op2_predicts_learned_languages_and_und(spark, corpus):
    rows = scored(spark, corpus, "op2_language", 4, 2)
    by_id = {r.doc_id: r for r in rows}
    held = [k for k in range(600) if crc(k) % 4 == 2 and k != 7]
    assert np.mean([by_id[k].lang_pred == corpus["docs"][k][2] for k in held]) > 0.97
    for r in rows:
        text = next(d[1] for d in corpus["docs"] if d[0] == r.doc_id)
        if r.doc_id not in (None, 7):
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
            assert r.lang_pred in {"und", "xx", *LANGUAGES}


def test_languages_are_voted_as_plain_loops_would():
    rng = random.Random(4)
    model = language_id.learn_languages([(prose(rng, lang, 40), lang) for lang in LANGUAGES for _ in range(40)])
    texts = [prose(rng, lang, n) for lang in LANGUAGES for n in (1, 3, 30)]
    names, _ = model.predict(texts)
    for text, name in zip(texts, names):
        x = np.append(language_id.trigram_shares([text])[0], 1).astype("f4")
        family = model.families[int(np.argmax([x @ model.family_weights[:, k] for k in range(len(model.families))]))]
        votes = {lang: [0, 0.0] for lang in model.members[family]}
        for (a, b), w in model.pair_weights.items():
            if a in votes:
                margin = float(x @ w)
                votes[a if margin > 0 else b][0] += 1
                votes[a][1], votes[b][1] = votes[a][1] + margin, votes[b][1] - margin
        assert name == max(votes, key=lambda lang: tuple(votes[lang]))


def test_op3_classes_match_brute_force(spark, corpus):
    rows = queries.op3_minhash(spark, corpus["where"]).collect()
    assert len(rows) == len(corpus["docs"])
    docs = spark.read.parquet(f"{corpus['where']}/documents.parquet")
    tables = minhash.count_shingles(docs)
    own = [d for d in corpus["docs"] if d[0] is not None]
    vectors = [(f, minhash.weights(tables, f, c)) for f, c in minhash.shingles([d[1] or "" for d in own])]
    links = [(own[a][0], own[b][0]) for a, b in itertools.combinations(range(len(own)), 2) if minhash.similarity(vectors[a], vectors[b]) >= 0.8]
    want = components([x for x in links if x[0] != x[1]])
    assert all(r.class_id == want.get(r.doc_id, r.doc_id) and r.kept == (r.doc_id is None or r.class_id == r.doc_id) for r in rows)
    assert {want.get(k) for k in (1000, 1001, 1002, 1100, 1101)} == {1000}


def test_op4_counts_match_brute_force(spark, corpus):
    found = {r.vec_id: r for r in queries.op4_hnsw(spark, corpus["where"]).collect()}
    want = brute_links(corpus["vectors"])
    assert {k: (found[k].n_links, found[k].component_id) for k in want} == want
    assert all(r.kept == (r.vec_id is None or r.component_id == r.vec_id) for r in found.values())
    assert all(found[k].n_links == 0 and found[k].component_id == k for k, _ in corpus["odd_vectors"])
    assert len(found) == len(corpus["vectors"]) + len(corpus["odd_vectors"])


def test_op5_digests_are_the_library_s(spark, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows, want = queries.op5_pieces(spark, corpus["where"]).collect(), []
    for key, text, *_ in corpus["docs"]:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r)[:4] for r in rows))) == sorted(map(str, want))


def test_op6_payloads_come_back(spark, corpus):
    rows, want = queries.op6_media(spark, corpus["where"]).collect(), []
    for key, text, *_ in corpus["docs"]:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        want.append(
            (key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        )
    assert sorted(map(str, (tuple(r)[:7] for r in rows))) == sorted(map(str, want))
    assert len({(r.payload_sha256, r.feature, r.tile_sha256) for r in rows}) == len({r.payload_sha256 for r in rows})


def test_op7_rows_and_starts_are_the_tokenizer_s(spark, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(queries.op7_token_columns(spark, corpus["where"]).collect(), key=lambda r: r.start)
    start, want = 0, sorted(corpus["docs"], key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    for r, (key, text, *_) in zip(rows, want, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def plain_statistics(text):
    """Each of quality.STATISTICS straight from its meaning."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * 16
    n, c = len(words), len(text)
    count = lambda signs: sum(text.count(s) for s in signs)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = [chr(k) for k in range(33, 127) if not chr(k).isalnum() and chr(k) not in ",."]
    ends = len(re.findall(r"[.!?]+(?=\s|$)", text)) or 1
    return [
        n, (c - n) / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, max(words.count(w) for w in set(words)) / n,
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, count("0123456789") / c, count("!?") / c, count(symbols) / c, count("|") / c, sum(w.isupper() for w in words) / n, n / ends, n / len(lines),
        1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), count("<>[]{}") / c,
    ]


def test_op8_scores_and_statistics(spark, corpus, monkeypatch):
    rows = scored(spark, corpus, "op8_quality", 5, 0)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    held = [k for k in range(600) if crc(k) % 5 == 0 and k != 7]
    assert np.mean([by_id[k].predicted == (k % 7 != 0) for k in held]) > 0.97
    rng = random.Random(8)
    texts = [
        sentences(rng, 20).replace(". ", rng.choice([". ", ".\n", "!\n\n", " | "])) for _ in range(30)
    ] + ["A A a a\nA A a a\n[x]", "no end", "\n\n. . .\n", "é Ünï. ②"]
    for chars in (10**6, 50):
        monkeypatch.setattr(quality, "PART_CHARS", chars)
        for text in texts:
            assert quality.statistics(text) == pytest.approx(plain_statistics(text)), text


def test_op9_removes_what_stands_before(spark, tmp_path):
    rng = random.Random(5)
    passage, rows = words(rng, 70), []
    for k in range(12):
        own = sentences(rng, 6)
        rows.append((k, f"{own[:90]} {passage} {own[90:]}" if k % 3 == 0 else own, "en", "s", 0))
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op9_sentence_spans(spark, str(tmp_path)).collect()}
    assert [k for k in range(12) if passage in found[k].text] == [0]
    for k, text, *_ in rows:
        left, at = "", 0
        for a, b in found[k].removed:
            left, at = left + text[at:a], b
        assert left + text[at:] == found[k].text and (found[k].n_removed > 0) == (k % 3 == 0 and k > 0)


def test_op10_meets_its_targets_also_without_ids(spark, tmp_path):
    rng = random.Random(6)
    rows = [(None if k % 4 == 0 else k, words(rng, rng.randint(1, 40)), "en", None if k % 4 == 0 else f"s{k % 4}", 0) for k in range(800)]
    rows += [(None, None, None, "s1", None), (3, "", "en", "s3", 0)]
    docs = spark.createDataFrame(rows, DOC)
    docs.select(
        "*", *[F.lit("own").alias(c) for c in ("whole", "below", "plan_source", "draw", "ratio", "level", "words")]
    ).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op10_mixing(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = fill(sizes)
    for source, size in sizes.items():
        own = [r for r in found if r.source_size == size]
        assert own and all(r.target == pytest.approx(targets[source]) and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - targets[source]) <= 40
    again = queries.op10_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
