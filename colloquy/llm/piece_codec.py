"""SentencePiece encoding and decoding that keeps the place of every piece in the source.

The model's compiled character map is read here: at each position the longest key that the text starts with is replaced,
and for every byte made, the source byte it came from is recorded. Pieces follow each other in the normalised bytes, so
running sums of their lengths are places in it, and the record projects them to spans of source bytes.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, process_cache, tidy

SPACE = "▁".encode()
CHUNK_CHARS = 2_000_000


class CharacterMap:
    """The compiled map: a double-array trie whose leaves point at zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key at this place, and its replacement."""
        units, found = self.units, None
        if not units:
            return None
        node = self._children(0)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[k]:  # the label of the edge
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:  # a key ends here
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.replacements[start : self.replacements.index(b"\0", start)]
        return found

    def _children(self, node: int) -> int:
        return node ^ self._offset(self.units[node])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy_prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map.units and self.escape and not self.squeeze and not model.trainer_spec.treat_whitespace_as_suffix
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with white space as a suffix aren't supported")
        self.unknown = self.library.unk_id()
        self.piece_bytes = np.array([1 if p.type == p.BYTE else 0 if p.type in (p.CONTROL, p.UNKNOWN) else len(p.piece.encode()) for p in model.pieces], "i8")

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each and for the end the source byte where it came from."""
        raw = text.encode()
        return self._plain(raw) if self.plain else self._mapped(raw)

    def _plain(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        if not raw:
            return b"", np.zeros(1, "i8")
        source = np.arange(len(raw) + 1)
        times = np.where(np.frombuffer(raw, "u1") == 32, len(SPACE), 1)
        align = np.repeat(source, np.append(times, 1))
        made = raw.replace(b" ", SPACE)
        if self.dummy_prefix:
            made, align = SPACE + made, np.concatenate([np.zeros(len(SPACE), "i8"), align])
        return made, align

    def _mapped(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        space, made, align, at = SPACE if self.escape else b" ", bytearray(), [], 0
        after_space, began = self.squeeze, False  # where white space is squeezed, none stands at the start
        while at < len(raw):
            found = self.map.longest(raw, at)
            if found:
                width, piece = found
            else:
                width = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                piece = raw[at : at + width]
            if after_space:
                piece = piece.lstrip(b" ")
            if not began and (piece or not self.squeeze):
                began = True
                if self.dummy_prefix:
                    made += space
                    align += [at] * len(space)
            if piece:
                new = piece.replace(b" ", space)
                made += new
                align += [at] * len(new)
                after_space = self.squeeze and piece.endswith(b" ")
            at += width
        end = len(raw)
        if self.squeeze:
            while made.endswith(space):
                end = align[len(made) - len(space)]
                del made[-len(space) :], align[-len(space) :]
        return bytes(made), np.array([*align, end], "i8")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids with begin and end, as the library gives them."""
        return [np.array(x, "<u4") for x in self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)]

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Begin and end of each piece in the source's bytes. Begin and end ids get empty spans at the text's ends."""
        made, align = self.normalise(text)
        width = self.piece_bytes[ids]
        ends = np.cumsum(width)
        if len(ids) and ends[-1] != len(made):  # an unknown piece is as long as what the others leave
            lost = np.flatnonzero(ids == self.unknown)
            width = width.copy()
            if len(lost) == 1:
                width[lost[0]] += len(made) - ends[-1]
            else:  # the library tells what several unknown pieces hold, in normalised text
                names = self.library.encode(text, out_type=str, add_bos=True, add_eos=True)
                width[lost] = [len(names[k].encode()) for k in lost]
            ends = np.cumsum(width)
        return align[np.stack([ends - width, ends], axis=1)] if len(ids) else np.zeros((0, 2), "i8")

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def codec(path: str) -> PieceCodec:
    cache = process_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = PieceCodec(path)
    return cache["pieces", path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, token_ids, starts and ends (source byte spans of the pieces). A null text is an empty one."""

    def encode(batches):
        pieces = codec(model)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in in_chunks(texts, CHUNK_CHARS):
                ids = pieces.encode(texts[part])
                spans = [pieces.spans(text, x) for text, x in zip(texts[part], ids)]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4"))
                flat = np.concatenate(spans)
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).astype("i4"))) for x in (np.concatenate(ids), flat[:, 0], flat[:, 1])
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], *lists], ["doc_id", "token_ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(encode), "doc_id long, token_ids array<int>, starts array<int>, ends array<int>")


def decode_documents(tokens: DataFrame, model: str) -> DataFrame:
    """doc_id and text from token_ids."""

    def decode(batches):
        pieces = codec(model)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(tidy(decode), "doc_id long, text string")


def codec_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (over begins and ends of all pieces as
    little-endian 32-bit integers), from one round trip. Null texts are empty ones; every row gives one row."""

    def digest(batches):
        pieces = codec(model)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in in_chunks(texts, CHUNK_CHARS):
                ids = pieces.encode(texts[part])
                decoded = pieces.library.decode([x.tolist() for x in ids])
                spans = [zlib.crc32(pieces.spans(text, x).astype("<i4").tobytes()) for text, x in zip(texts[part], ids)]
                columns = [
                    pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]), pa.array(spans, pa.int64())
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(digest), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
