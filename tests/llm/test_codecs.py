import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import media, piece_codec, token_columns

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    "Hello world.", "", " lead and  two spaces ", "über\nnaïve\tçà  ", "日本語 ☃ 🙂 a", "a<|endoftext|> b", "x" * 5000, "don't stop, can’t? 3.14 ½", "nb  sp",
    "<s> </s> <unk> ▁x"
]


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_and_text_are_the_library_s(pieces):
    for text, ids in zip(TEXTS, pieces.encode(TEXTS)):
        assert ids.tolist() == pieces.library.encode(text, add_bos=True, add_eos=True)
        assert pieces.decode(ids) == pieces.library.decode(ids.tolist())


def test_spans_cover_the_source_in_order(pieces):
    for text, ids in zip(TEXTS, pieces.encode(TEXTS)):
        spans, raw = pieces.spans(text, ids), text.encode()
        assert len(spans) == len(ids) and (spans[1:, 0] == spans[:-1, 1]).all()
        if raw:
            assert spans[0].tolist() == [0, 0] and spans[-1].tolist() == [len(raw)] * 2
            found = [p.surface for p in pieces.library.encode(text, return_type="proto").pieces]
            plain = not any(pieces.library.is_byte(int(k)) for k in ids)
            assert not plain or [raw[a:b].decode() for a, b in spans[1:-1]] == found


def compiled_map(pairs: dict[bytes, bytes]) -> bytes:
    """A double array for a small map: nodes are placed one after the other, each at a base that leaves room for all."""
    replacements, starts = b"", {}
    for key, value in sorted(pairs.items()):
        starts[key] = len(replacements)
        replacements += value + b"\0"
    nodes = sorted({key[:k] for key in pairs for k in range(len(key) + 1)})
    base = {node: 512 * (k + 1) for k, node in enumerate(nodes)}
    units = [0] * (512 * (len(nodes) + 2))

    def unit(node, place):
        offset = base[node] ^ place
        packed = offset << 10 if offset < 1 << 21 else (offset >> 8) << 10 | 1 << 9
        return packed | (1 << 8 if node in pairs else 0) | (node[-1] if node else 0)

    units[0] = unit(b"", 0)
    for node in nodes:
        if node in pairs:
            units[base[node]] = starts[node] | 1 << 31
        for child in (n for n in nodes if len(n) == len(node) + 1 and n.startswith(node)):
            units[base[node] ^ child[-1]] = unit(child, base[node] ^ child[-1])
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + replacements


@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_map_normalises_as_the_library_does(tmp_path, squeeze):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    pairs = {
        "ﬁ".encode(): b"fi", "A".encode(): b"a", "AB".encode(): b"z", "　".encode(): b" ", "①".encode(): b"(1)", b"\t": b" ", "é".encode(): "e".encode(),
        b"q": b""
    }
    model.normalizer_spec.precompiled_charsmap = compiled_map(pairs)
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "mapped.model"
    path.write_bytes(model.SerializeToString())
    codec = piece_codec.PieceCodec(str(path))
    for text in ("ABA ﬁne ① x", "  two  　spaces é ", "", "A", "tab\tend ", "aqb", "   "):
        made, align = codec.normalise(text)
        assert made.decode() == codec.library.normalize(text), text
        assert len(align) == len(made) + 1 and (np.diff(align) >= 0).all()
        ids = codec.encode([text])[0]
        spans = codec.spans(text, ids)
        assert (spans[:, 0] <= spans[:, 1]).all() and spans.max(initial=0) <= len(text.encode())
    made, align = codec.normalise("xABA")
    assert made.decode().endswith("xza") and align[-4:].tolist() == [0, 1, 3, 4]


def test_spans_of_several_unknown_pieces(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.byte_fallback = False
    for piece in model.pieces:
        if piece.type == piece.BYTE:
            piece.type = piece.UNUSED
    model.normalizer_spec.precompiled_charsmap = compiled_map({"①".encode(): "☄☄☄".encode()})
    path = tmp_path / "unknown.model"
    path.write_bytes(model.SerializeToString())
    codec = piece_codec.PieceCodec(str(path))
    text = "a ☄ bc ① de ☄ f"
    ids = codec.encode([text])[0]
    assert (ids == codec.unknown).sum() >= 2
    spans, raw = codec.spans(text, ids), text.encode()
    assert (spans[1:, 0] <= spans[:-1, 1]).all() and spans[-1].tolist() == [len(raw)] * 2
    assert [raw[a:b].decode().strip() for (a, b), k in zip(spans, ids) if k == codec.unknown] == [s.strip() for s in ("☄", "①", "☄")]


def test_codec_digests_of_a_table(spark, documents, empty, pieces):
    docs = documents([*enumerate(TEXTS), (100, None), (None, "x"), (3, TEXTS[3])]).withColumn("n_tokens", F.lit("clash"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_codec.codec_digests(docs, path).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = "" if r.doc_id == 100 else "x" if r.doc_id is None else TEXTS[r.doc_id]
        ids = pieces.library.encode(text, add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest()
    tokens = piece_codec.encode_documents(docs, path)
    back = {r.doc_id: r.text for r in piece_codec.decode_documents(tokens, path).collect()}
    assert back[0] == TEXTS[0] and back[100] == "" and piece_codec.encode_documents(empty, path).count() == 0


def test_words_encode_as_the_tokenizer_does():
    encoder = token_columns.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [
        *TEXTS, "word, word. word!! (word) it's it’s a1b2 x\n\ny z_w", "tail.\nNext line's end,  double", "é. ñ, ß! ½ ²x", "a \x01b, c", "one,two 3,4 x., y",
        ", z"
    ]
    for _ in range(2):
        ids, counts = encoder.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_words_of_one_hash_are_told_apart(monkeypatch):
    encoder = token_columns.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_columns, "_FACTORS", np.ones(token_columns.MAX_WORD_BYTES, "u8"))  # anagrams agree, and worse
    chunks = [
        ["first of all", "on no no on", "stop pots tops", "was saw"], ["first no", "saw", "the pots are tops"], ["first on", "a no", "opts"],
        ["first az by", "zz"]
    ]
    for texts in chunks:
        ids, counts = encoder.encode(texts)
        for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert own.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    table = token_columns.WordTable()
    raw = np.frombuffer(b"abba", "u1")
    table.insert(np.array([7], "u8"), np.array([0], "i4"), np.array([1], "i4"), [b"ab"])
    hit, _, _ = table.find(np.array([7, 7], "u8"), raw, np.array([0, 2]), np.array([2, 2], "i4"))
    assert hit.tolist() == [True, False]


def test_files_count_in_the_order_of_their_numbers(spark, documents, tmp_path):
    path = tmp_path / "tokens"
    docs = documents([(k, "word " * k) for k in range(40)])
    token_columns.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), str(path / "one"))
    token_columns.write_tokens(docs.withColumn("doc_id", F.col("doc_id") + 100), public_tokenizers.path("byte_bpe_50k.json"), str(path / "two"))
    (path / "both").mkdir()
    for folder, number in (("one", 99_998), ("two", 100_000)):
        for k, f in enumerate(sorted((path / folder).glob("part-*.parquet"))):
            f.rename(path / "both" / f"part-{number + k}-x.c000.snappy.parquet")
    found = sorted(token_columns.token_offsets(spark, str(path / "both")).collect(), key=lambda r: r.doc_id)
    assert len(found) == 80
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_come_back_in_order(spark, documents, empty, tmp_path, encoding):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(k * 7 % 101, TEXTS[k % len(TEXTS)]) for k in range(101)] + [(500, None), (None, "first"), (600, "same"), (600, "same")]
    path = str(tmp_path / "tokens")
    token_columns.write_tokens(documents(rows).withColumn("token_ids", F.lit(1)), public_tokenizers.path("byte_bpe_50k.json"), path, list_encoding=encoding)
    found = sorted(token_columns.token_offsets(spark, path).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    start = 0
    for r, (key, text) in zip(found, want, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_columns.read_tokens(spark, path, 10, 12)
    assert sorted(r.doc_id for r in some.collect()) == [10, 11, 12]
    import pyarrow.parquet as pq

    part = next(f for f in (tmp_path / "tokens").glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    group = pq.ParquetFile(part).metadata.row_group(0)
    kinds = {group.column(k).path_in_schema: set(group.column(k).encodings) for k in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"]
    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in kinds["token_ids.list.element"]
    assert group.column(0).has_offset_index and group.column(0).has_column_index
    token_columns.write_tokens(empty, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "none"))
    assert token_columns.token_offsets(spark, str(tmp_path / "none")).count() == 0


def test_netpbm_and_bmp_round_trips():
    rng = np.random.default_rng(4)
    for shape in ((5, 7, 3), (1, 1, 3), (9, 4), (64, 33, 3)):
        image = rng.integers(0, 256, shape).astype("u1")
        assert (media.decode_image(media.encode_netpbm(image)) == image).all()
        bmp = media.decode_image(media.encode_bmp(image))
        assert (bmp == (image if image.ndim == 3 else image[:, :, None])).all()
    assert media.decode_netpbm(b"P1\n# note\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode_netpbm(b"P4 3 2\n" + bytes([0b10100000, 0b01000000])).tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode_netpbm(b"P2\n2 1\n255\n7 200").tolist() == [[7, 200]]
    assert media.decode_netpbm(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode_netpbm(b"P5 2 1 65535\n" + bytes([1, 0, 0, 2])).tolist() == [[256, 2]]
    palette = b"BM" + bytes(8) + (62).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\1\0\1\0" + bytes(24) + bytes([0, 0, 255, 0, 0, 255, 0, 0]) + bytes([0b01000000, 0, 0, 0])
    assert media.decode_bmp(palette).tolist() == [[[255, 0, 0], [0, 255, 0]]]


def test_area_resize_is_the_mean_under_each_pixel():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (12, 20)).astype("f8")
    assert np.allclose(media.area_resize(image, 3, 5), image.reshape(3, 4, 5, 4).mean((1, 3)))
    fine = np.repeat(np.repeat(image, 7, axis=0), 9, axis=1)  # every new pixel is whole blocks of these
    assert np.allclose(media.area_resize(image, 7, 9), fine.reshape(7, 12, 9, 20).mean((1, 3)))
    assert np.allclose(media.area_resize(np.full((1, 1), 9.0), 4, 4), 9)


def test_tiles_and_broken_images(spark):
    image = np.arange(300, dtype="u1").reshape(10, 10, 3)
    rows = [
        (1, bytearray(media.encode_netpbm(image))), (2, bytearray(media.encode_bmp(image))), (3, None), (4, bytearray(b"")),
        (5, bytearray(b"P6 9 9 255\nshort")), (6, bytearray(b"GIF89a"))
    ]
    found = {r.k: r for r in media.image_tiles(spark.createDataFrame(rows, "k long, data binary"), "k", "data", 4, 4).collect()}
    assert found[1].tile == found[2].tile and found[1].dhash == found[2].dhash and found[1].error is None
    assert np.load(io.BytesIO(found[1].tile)).shape == (4, 4, 3)
    assert all(found[k].tile is None and found[k].error for k in (3, 4, 5, 6))


def test_tiles_of_any_sample_range(spark):
    rng = np.random.default_rng(6)
    image = rng.integers(0, 16, (8, 8)).astype("u1")
    files = [
        b"P5 8 8 15\n" + image.tobytes(), b"P5 8 8 255\n" + (image * 17).tobytes(), b"P5 8 8 65535\n" + (image.astype(">u2") * 4369).tobytes(),
        b"P2 8 8 15\n" + b" ".join(b"%d" % x for x in image.ravel())
    ]
    found = media.image_tiles(spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(files)], "k long, data binary"), "k", "data", 4, 4).collect()
    assert len({bytes(r.tile) for r in found}) == 1 and len({r.dhash for r in found}) == 1


def test_text_payloads_are_lossless(spark, documents, empty):
    docs = documents([*enumerate(TEXTS), (100, None), (None, "x")]).withColumn("media", F.lit("clash"))
    rows = media.store_text_media(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert np.load(io.BytesIO(r.tile)).shape == (media.TILE_SIDE, media.TILE_SIDE, 3)
        raw = ("" if r.doc_id == 100 else "x" if r.doc_id is None else TEXTS[r.doc_id]).encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload)) and r.payload_bytes % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:]) and len(r.feature) == 16
    assert media.store_text_media(empty).count() == 0


def test_ids_of_32_bits_and_one_id_of_many_rows(spark, rng, tmp_path, request):
    from colloquy.llm import hnsw, language_id, minhash

    rows = [(7, f"{rng.random()} text number {k}") for k in range(400)] + [(k, f"other {k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    assert language_id.predict_languages(docs, language_id.LanguageModel()).count() == 420
    assert piece_codec.codec_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 420 and media.store_text_media(docs).count() == 420
    assert minhash.near_duplicate_classes(docs).count() == 420
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert sorted((r.vec_id, r.component_id) for r in hnsw.near_embeddings(vectors).collect()) == [(1, 1), (2, 1), (3, 3)]
    path, few = str(tmp_path / "tokens"), "spark.sql.adaptive.coalescePartitions.enabled"
    request.addfinalizer(lambda: spark.conf.unset(few))
    spark.conf.set(few, "false")  # so few rows would be joined to one task again
    token_columns.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    files = spark.read.parquet(path).groupBy("_metadata.file_name").count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 300  # the rows of one id are several tasks' work
    got = token_columns.token_offsets(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(k for k, _ in rows)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
