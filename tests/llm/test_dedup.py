import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import graph, hnsw, minhash, sentence_spans

from .conftest import sentences, words


def components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(8)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [
        (rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)
    ] + [(7, 7)]
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    want = components([p for p in pairs if p[0] != p[1]])
    assert found == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(3)
    pool = np.sort(rng.integers(0, 1 << 63, 1200, "u8"))
    agreed = []
    for part in range(40):
        a, b = np.sort(rng.choice(pool, 900, replace=False)), np.sort(rng.choice(pool, 900, replace=False))
        x, y = rng.uniform(0.5, 3, 900).astype("f4"), rng.uniform(0.5, 3, 900).astype("f4")
        agreed.append(((minhash.signature(a, x) == minhash.signature(b, y)).mean(), minhash.similarity((a, x), (b, y))))
    drawn, true = np.array(agreed).mean(0)
    assert abs(drawn - true) < 0.03


def test_classes_match_brute_force(spark, documents, rng):
    texts = []
    for k in range(40):
        base = words(rng, 120).split()
        texts.append(" ".join(base))
        for n in range(k % 4):
            copy = list(base)
            for _ in range(1 + n):
                copy[rng.randrange(len(copy))] = words(rng, 1) + "x"
            texts.append(" ".join(copy))
        if k % 5 == 0:
            texts.append("  " + " ".join(base).upper() + "!")  # same words
    docs = documents(list(enumerate(texts)))
    tables = minhash.count_shingles(docs)
    vectors = [(f, minhash.weights(tables, f, c)) for f, c in minhash.shingles(texts)]
    want = components([(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if minhash.similarity(vectors[a], vectors[b]) >= 0.8])
    found = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(docs).collect()}
    assert found == {k: want.get(k, k) for k in range(len(texts))}


def test_small_blocks_lose_no_link(spark, documents, monkeypatch):
    """Chains, in which no hub reaches all, and a large group with documents that are nearly like it, over many blocks."""
    monkeypatch.setattr(minhash, "BLOCK_DOCUMENTS", 3)
    rng = random.Random(12)
    texts = []
    for _ in range(3):
        chain = words(rng, 80).split()
        for k in range(24):
            texts.append(" ".join(chain))
            chain[(k * 5) % 80] = words(rng, 1) + "y"
    base = words(rng, 100).split()
    for k in range(40):
        copy = list(base)
        for _ in range(1 if k < 25 else 4):
            copy[rng.randrange(100)] = f"odd{k}"
        texts.append(" ".join(copy))
    docs = documents(list(enumerate(texts)))
    tables = minhash.count_shingles(docs)
    vectors = [(f, minhash.weights(tables, f, c)) for f, c in minhash.shingles(texts)]
    want = components([(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if minhash.similarity(vectors[a], vectors[b]) >= 0.8])
    found = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(docs).collect()}
    assert found == {k: want.get(k, k) for k in range(len(texts))}


def test_shingles_count_and_stay_within_texts():
    texts = ["a b c d e f", "", "One two", "x y z w v", "... !"]
    found = minhash.shingles(texts)
    assert [len(f) for f, _ in found] == [2, 0, 1, 1, 0]
    alone = [minhash.shingles([t])[0][0].tolist() for t in texts]
    assert alone == [f.tolist() for f, _ in found]
    (f, times), = minhash.shingles(["go on " * 50])
    assert len(f) == 2 and times.sum() == 96


def test_words_between_marks_and_without_spaces(spark, documents, rng):
    some = words(rng, 60).split()
    dashes, other = "—".join(some), "—".join([*some[:30], "another", *some[31:]])
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(400))
    long = "".join(rng.choice("ab") for _ in range(9000))
    swapped = long[:5000] + long[5000:][::-1]
    rows = [(1, dashes), (2, other), (3, " ".join(some)), (4, han), (5, han + "天"), (6, han[::-1]), (7, f"a b c d {long}"), (8, f"a b c d {swapped}")]
    rows += [(9, " ".join(words(rng, 60).split())), (10, "\u00a0".join(some)), (11, "，".join(some))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(documents(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9}


def test_classes_of_odd_rows(spark, documents, empty, rng):
    text = words(rng, 50)
    docs = documents([(1, None), (2, ""), (None, text), (3, text), (4, text), (4, text), (5, "one two"), (6, "One, two."), (7, "!"), (8, text * 400)])
    rows = minhash.near_duplicate_classes(docs.withColumn("class_id", F.lit("clash")).withColumn("node", F.lit(0))).collect()
    found = {(r.doc_id, r.class_id) for r in rows}
    assert len(rows) == 10
    assert found == {(1, 1), (2, 2), (None, None), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8)}
    assert minhash.near_duplicate_classes(empty).count() == 0


def test_a_large_group_of_near_copies_is_one_class(spark, documents, rng):
    base = words(rng, 200).split()
    rows = []
    for k in range(400):
        copy = list(base)
        copy[rng.randrange(200)] = f"odd{k}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, words(rng, 60)) for k in range(30)]
    found = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(documents(rows)).collect()}
    assert {found[k] for k in range(400)} == {0} and all(found[1000 + k] == 1000 + k for k in range(30))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16)).astype("f4")
    near = (base[:60].repeat(3, axis=0) + rng.normal(scale=0.08, size=(180, 16))).astype("f4")
    big = (base[0] + rng.normal(scale=0.05, size=(150, 16))).astype("f4")
    x = np.concatenate([base, near, big, base[:10]])
    ids = rng.permutation(len(x)) * 3
    rows = [(int(k), v.tolist(), 0) for k, v in zip(ids, x)]
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    a, b = np.nonzero(unit @ unit.T >= 0.95)
    want = components([(int(ids[p]), int(ids[q])) for p, q in zip(a, b) if p != q])
    degree = np.bincount(a, minlength=len(x)) - 1
    found = {r.vec_id: r for r in hnsw.near_embeddings(vectors(spark, rows), shards=3).collect()}
    assert {int(k): int(d) for k, d in zip(ids, degree)} == {k: r.n_links for k, r in found.items()}
    assert all(r.component_id == want.get(k, k) and r.kept == (r.component_id == k) for k, r in found.items())


def brute_links(rows):
    """n_links and component_id of each (vec_id, vector) from all pairs."""
    ids, x = [k for k, _ in rows], np.array([v for _, v in rows], "f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(x @ x.T >= 0.95)
    classes = components([(ids[p], ids[q]) for p, q in zip(a, b) if p != q])
    return {k: (d - 1, classes.get(k, k)) for k, d in zip(ids, np.bincount(a, minlength=len(ids)).tolist())}


def test_vectors_of_extreme_size_keep_their_angles(spark):
    rows = [
        (1, [1e200, 1e200]), (2, [1e200, 0.99e200]), (3, [1e-200, 1e-200]), (4, [1e-200, -1e-200]), (5, [5e-324, 5e-324]), (6, [1.7e308, -1.7e308]),
        (7, [1.0, 0.0]), (8, [-1e-300, 1e300])
    ]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_embeddings(data).collect()}
    assert found == brute_links(rows)
    assert found[1] == (3, 1) and found[4] == (1, 4) and found[7] == (0, 7)


def test_links_are_symmetric_over_blocks_and_shards(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 12))
    x = np.concatenate([centres[k % 40 if k % 3 else 0] + rng.normal(scale=0.14, size=12) for k in range(1500)]).reshape(-1, 12).astype("f4")
    monkeypatch.setattr(hnsw, "BLOCK", 128)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_links([(k, v.astype("f8")) for k, v in enumerate(x)])
    for shards in (1, 5):
        found = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_embeddings(data, shards=shards).collect()}
        assert found == want


def test_a_beam_widens_where_planted_queries_are_lost():
    rng = np.random.default_rng(3)
    graph_ = hnsw.Graph(rng.normal(size=(3000, 48)))
    for layer in graph_.layers:
        layer[:, 2:] = -1  # a graph with too few ways
    graph_.audit(0.6)
    assert graph_.beam > hnsw.BEAM


def test_recall_of_the_graph_itself():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    graph_ = hnsw.Graph(x)
    queries = (x[:300] + rng.normal(scale=0.1, size=(300, 24)))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    best = (queries @ graph_.exact.T).argmax(1)
    nodes, _ = graph_.search(queries.astype("f4"), 32)
    assert (nodes == best[:, None]).any(1).mean() > 0.95
    assert len(graph_.layers) > 1


def test_odd_vectors_link_with_nothing(spark):
    rows = [
        (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0), (6, [], 0), (7, [1.0, 0.0], 0),
        (8, [2.0, 0.0], 0), (8, [2.0, 0.0], 0), (None, [1.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0)
    ]
    data = vectors(spark, rows).withColumn("n_links", F.lit("clash"))
    found = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in hnsw.near_embeddings(data).collect())
    assert len(found) == len(rows)
    alone = {(False, k, 0, k, True) for k in (1, 2, 3, 4, 5, 6, 9)}
    assert alone <= set(found) and (False, 7, 2, 7, True) in found and found.count((False, 8, 2, 7, False)) == 2 and (True, 0, 0, None, True) in found
    assert hnsw.near_embeddings(vectors(spark, [])).count() == 0


def brute_spans(rows):
    """Runs as tuples of words, for texts whose sentences end in '. ' and are short."""
    runs, texts = {}, {}
    for key, text in rows:
        pieces = [p for p in text.split(". ")]
        n = [len(p.split()) for p in pieces]
        found = set()
        for a in range(len(pieces)):
            b = next((b for b in range(a + 3, len(pieces) + 1) if sum(n[a:b]) >= 25), None)
            found |= {(a, b)} if b else set()
            c = next((c for c in range(a - 2, -1, -1) if sum(n[c : a + 1]) >= 25), None)
            found |= {(c, a + 1)} if c is not None else set()
        texts[key] = pieces
        runs[key] = {(a, b): " ".join(pieces[a:b]).rstrip(".") for a, b in found}
    first = {}
    for key in sorted(runs):
        for text in runs[key].values():
            first.setdefault(text, key)
    return {key: {k for (a, b), text in runs[key].items() if first[text] != key for k in range(a, b)} for key in runs}, texts


def test_spans_match_brute_force(spark, documents, rng):
    passages = [sentences(rng, 6) for _ in range(4)]
    rows = []
    for k in range(40):
        parts = [sentences(rng, 5), sentences(rng, 4)]
        rows.append((k, f"{parts[0]} {passages[k % 4]} {parts[1]}" if k % 3 == 0 else " ".join(parts)))
    gone, pieces = brute_spans(rows)
    found = {r.doc_id: r for r in sentence_spans.remove_repeats(documents(rows)).collect()}
    for key, text in rows:
        want = "".join(p + (". " if k < len(pieces[key]) - 1 else "") for k, p in enumerate(pieces[key]) if k not in gone[key])
        assert found[key].text == want
    assert sum(r.n_removed for r in found.values()) >= 8


def test_spans_of_odd_rows(spark, documents, empty, rng):
    text, line = sentences(rng, 8), "All rights are kept by us."
    long = words(rng, 90)  # no marks at all
    docs = documents(
        [
            (1, text), (2, text), (2, text), (3, None), (None, text), (None, text), (4, line), (5, line), (6, "Go on. " * 500), (7, long),
            (8, f"{long} and more"), (9, "")
        ]
    )
    rows = sentence_spans.remove_repeats(docs.withColumn("removed", F.lit("clash")).withColumn("others", F.lit(1))).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and found[1].text == text and found[2].text == "" and found[3].text is None and found[9].text == ""
    assert [r.text for r in rows if r.doc_id is None] == [text, text]
    assert found[4].text == found[5].text == line
    assert 0 < len(found[6].text) < 400 and found[6].n_removed == 1
    assert found[7].text == long and found[8].text == " ".join(f"{long} and more".split()[80:])  # the last piece differs
    assert found[8].removed[0].start == 0 and found[5].others == 1
    assert sentence_spans.remove_repeats(empty).count() == 0


def test_passages_at_any_offset_go_to_their_true_ends(spark, documents, rng):
    rows, want = [], {}
    for k in range(30):
        n = 49 + k
        passage = words(rng, n) if k % 2 else " ".join(f"{w}." if p % 11 == 7 else w for p, w in enumerate(words(rng, n).split()))
        before, after = words(rng, 60 + rng.randrange(16)), words(rng, 40)
        rows += [(k, f"{words(rng, 20)} {passage} {words(rng, 30)}"), (100 + k, f"{before} {passage} {after}")]
        want[100 + k] = before, passage, after
    found = {r.doc_id: r.text for r in sentence_spans.remove_repeats(documents(rows)).collect()}
    assert all(found[key] == text for key, text in rows if key < 100)
    for key, (before, passage, after) in want.items():
        left = found[key].removeprefix(f"{before} ").removesuffix(after).split()
        assert found[key].startswith(before) and found[key].endswith(after)
        assert len(left) < sentence_spans.PIECE_WORDS and passage.split()[len(passage.split()) - len(left) :] == left
        assert not left or len(before.split()) % sentence_spans.PIECE_WORDS == 4  # pieces of both copies have the same edges
    assert sum(found[key] == f"{b} {a}" for key, (b, _, a) in want.items()) >= 27


def test_a_passage_twice_in_one_text_goes_once(spark, documents, rng):
    passage, gap, end = words(rng, 80), words(rng, 13), words(rng, 9)
    found = sentence_spans.remove_repeats(documents([(1, f"{passage} {gap} {passage} {end}")])).collect()[0]
    assert found.text == f"{passage} {gap} {end}"


def test_spans_of_texts_with_long_lower_case_and_without_spaces(spark, documents, rng):
    passage, start = sentences(rng, 6), sentences(rng, 3)
    signs = "".join(chr(c) for c in range(0x4E00, 0x4F00))
    wide = ["".join("".join(rng.choices(signs, k=9)) + mark for mark in "。！？。") for _ in range(4)]
    inner = "".join(rng.choices(signs, k=60))
    rows = [
        (1, passage), (2, f"{start} İzmir. {passage}"), (3, wide[0] + wide[1]), (4, wide[2] + wide[1]), (5, inner), (6, f"{wide[3][:7]}{inner}{wide[3][8:]}")
    ]
    found = {r.doc_id: r.text for r in sentence_spans.remove_repeats(documents(rows)).collect()}
    assert found == {1: passage, 2: f"{start} İzmir. ", 3: wide[0] + wide[1], 4: wide[2], 5: inner, 6: wide[3][:7] + wide[3][8:]}
