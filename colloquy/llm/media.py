"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, kept as NPY tiles with
difference hashes. Arrays are height x width (grey) or height x width x 3 (red, green, blue)."""

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, in_chunks, tidy

ROW_BYTES = 192
HASH_COLUMNS, HASH_ROWS = 8, 8
TILE_SIDE = 8
CHUNK_CHARS = 4_000_000


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """So many numbers after the magic, with comments skipped, and where they end."""
    numbers, at = [], 2
    while len(numbers) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken Netpbm header")
        numbers.append(int(data[at:end]))
        at = end
    return numbers, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6. Samples of bitmaps are 0 (black) or 255; those of 16 bits stay so."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm image")
    numbers, at = _header(data, 2 if kind in (b"P1", b"P4") else 3)
    width, height, most = [*numbers, 1][:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if width < 1 or height < 1 or not 1 <= most <= 65535:
        raise ValueError("broken Netpbm header")
    if kind == b"P4":
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, "u1", row * height, at + 1).reshape(height, row), axis=1)[:, :width]
        return np.where(bits, 0, 255).astype("u1")
    if kind == b"P1":
        bits = [c for c in data[at:] if c in b"01"][: width * height]
        return np.where(np.array(bits, "u1").reshape(height, width) == 49, 0, 255).astype("u1")
    if kind in (b"P2", b"P3"):
        samples = np.array(data[at:].split()[: width * height * depth], "i8").astype("u2" if most > 255 else "u1")
    else:
        samples = np.frombuffer(data, ">u2" if most > 255 else "u1", width * height * depth, at + 1)
    return samples.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_netpbm(image: np.ndarray) -> bytes:
    height, width = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, width, height) + np.ascontiguousarray(image, "u1").tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed, of 1, 4, 8, 24 or 32 bits, bottom up or top down."""
    if data[:2] != b"BM":
        raise ValueError("no BMP image")
    number = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, header, width, height, bits, packed, colours = number(10), number(14), number(18, 4, True), number(22, 4, True), number(28, 2), number(30), number(46)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise ValueError("no such BMP image")
    row = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, "u1", row * abs(height), start).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if bits in (24, 32):
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    palette = np.frombuffer(data, "u1", 4 * (colours or 1 << bits), 14 + header).reshape(-1, 4)[:, 2::-1]
    unpacked = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], axis=2).reshape(abs(height), -1)
    return palette[unpacked[:, :width]]


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits, bottom up."""
    image = np.repeat(image[:, :, None], 3, axis=2) if image.ndim == 2 else image
    height, width = image.shape[:2]
    rows = np.zeros((height, (width * 3 + 3) // 4 * 4), "u1")
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    put = lambda *xs: b"".join(x.to_bytes(n, "little") for x, n in xs)
    return b"BM" + put(
        (54 + rows.size, 4), (0, 4), (54, 4), (40, 4), (width, 4), (height, 4), (1, 2), (24, 2), (0, 4), (rows.size, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)
    ) + rows.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def decode_scaled(data: bytes) -> np.ndarray:
    """The image with samples from 0 to 255, whatever the greatest value that its header names."""
    image, most = decode_image(data), 255
    if data[:2] in (b"P2", b"P3", b"P5", b"P6"):
        most = _header(data, 3)[0][2]
    return image if most == 255 else image * (255 / most)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each new pixel, from differences of the integral image, edges weighed by their
    share. Doubles; for images of any size, larger or smaller than the new one."""
    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    table[1:, 1:] = image.astype("f8").cumsum(0).cumsum(1)

    def at_edges(x: np.ndarray, n: int) -> np.ndarray:
        place = np.arange(n + 1) * (len(x) - 1) / n
        low = np.minimum(place.astype("i8"), len(x) - 2)
        share = (place - low).reshape(-1, *[1] * (x.ndim - 1))
        return x[low] * (1 - share) + x[low + 1] * share

    rows = np.diff(at_edges(table, height), axis=0)
    sums = np.diff(at_edges(rows.swapaxes(0, 1), width), axis=0).swapaxes(0, 1)
    return sums * (height * width / (image.shape[0] * image.shape[1]))


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype("f8") if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each pixel of the resized grey image is brighter than its right neighbour."""
    small = np.rint(area_resize(grey(image), HASH_ROWS, HASH_COLUMNS + 1) * 256)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, height: int, width: int) -> bytes:
    """The image (samples from 0 to 255) resized to 8-bit samples, as an NPY file."""
    return npy_tile(np.clip(np.rint(area_resize(image, height, width)), 0, 255).astype("u1"))


def npy_tile(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, image, allow_pickle=False)
    return out.getvalue()


def image_tiles(media: DataFrame, key: str, column: str, height: int = 64, width: int = 64) -> DataFrame:
    """key, tile (an NPY file of the area-resized image, 8 bits), dhash and error. Null, empty or broken images give a
    null tile and hash and say why; every row gives one row."""

    def tiles(batches):
        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                try:
                    image = decode_scaled(data or b"")
                    found.append((tile(image, height, width), difference_hash(image), None))
                except (ValueError, IndexError) as e:
                    found.append((None, None, str(e)))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, kind) for x, kind in zip(columns, (pa.binary(), pa.string(), pa.string())))], [key, "tile", "dhash", "error"]
            )

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(tidy(tiles), f"`{key}` {kind}, tile binary, dhash string, error string")


def text_payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // ROW_BYTES)) * ROW_BYTES, b" ")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as the samples of a P6 image 64 pixels wide. Null texts are empty ones; rows
    that repeat and null ids give a row each, an empty table none."""

    def images(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for part in in_chunks(texts, CHUNK_CHARS):
                media = [encode_netpbm(np.frombuffer(text_payload(x), "u1").reshape(-1, ROW_BYTES // 3, 3)) for x in texts[part]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], pa.array([len(x.encode()) for x in texts[part]], pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(images), "doc_id long, n_bytes long, media binary")


def media_tiles(media: DataFrame, side: int = TILE_SIDE) -> DataFrame:
    """doc_id, n_bytes, and what the stored bytes hold: payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, tile (an NPY file of the image resized to side x side) and feature (the difference hash)."""

    def features(batches):
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                data = batch.column(2)[at].as_py()
                image = decode_image(data)
                payload = image.tobytes()
                rows.append(
                    (
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                        tile(image, side, side), difference_hash(image)
                    )
                )
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, kind) for x, kind in zip(columns, kinds))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tile", "feature"]
            )

    return media.mapInArrow(
        tidy(features),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tile binary, feature string"
    )


def store_text_media(docs: DataFrame) -> DataFrame:
    """The media column and then the tiles are written to the shared folder as Parquet; what is returned is read from the
    tiles' files: the columns of `media_tiles`. The media go when the tiles, made from them as read back, are written."""
    with Scratch(docs.sparkSession) as tables:
        media = tables.cut(text_media(docs), "media", compression="zstd")
        return cut(media_tiles(media), "tiles", compression="zstd")
