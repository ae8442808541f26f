"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, enclose, materialise, release, table

#: A text's bytes fill whole blocks; an image row has WIDTH of them.
BLOCK = 576
WIDTH = 24
TILE = 16
FEATURES = "width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, tile binary, fault string"


def encode_pgm(image: np.ndarray) -> bytes:
    """Binary grey or colour Netpbm (P5 or P6) of an 8-bit array."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed bottom-up BMP: 8 bits with a grey palette, or 24 bits."""
    grey = image.ndim == 2
    rows = image[::-1] if grey else image[::-1, :, ::-1]
    rows = np.ascontiguousarray(rows).reshape(len(rows), -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype="u1"), 4).reshape(256, 4) * np.array([1, 1, 1, 0], "u1") if grey else np.zeros(0, "u1")
    at = 54 + palette.nbytes
    return b"BM" + struct.pack("<IHHI", at + rows.nbytes, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, image.shape[1], image.shape[0], 1, 8 if grey else 24, 0, rows.nbytes, 2835, 2835, 256 if grey else 0, 0) + palette.tobytes() + rows.tobytes()


def _netpbm_numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """n numbers of a Netpbm header from `at`, with comments, and the place after the one white space that ends them."""
    out: list[int] = []
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) if data[at : at + 1] == b"#" else at + 1
        z = at
        while data[z : z + 1].isdigit():
            z += 1
        out.append(int(data[at:z]))
        at = z
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width) or (height, width, 3); 8 bits, or 16 where the greatest value is beyond 255; bits as 0 and 1 (1 is black)."""
    kind = int(data[1:2])
    colour = 3 if kind in (3, 6) else 1
    (w, h, *top), at = _netpbm_numbers(data, 2, 2 if kind in (1, 4) else 3)
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, "u1", h * -(-w // 8), at).reshape(h, -1), axis=1)
        return bits[:, :w]
    if kind == 1:
        out = np.array([c - 48 for c in data[at - 1 :] if c in b"01"][: w * h], "u1")
    elif kind in (2, 3):
        out = np.array(data[at:].split()[: w * h * colour], dtype="u2" if top[0] > 255 else "u1")
    else:
        out = np.frombuffer(data, ">u2" if top[0] > 255 else "u1", w * h * colour, at)
    return out.reshape((h, w, 3) if colour == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: grey if its palette is, else colour (red, green, blue)."""
    at, size, w, h, _, bits, how = struct.unpack("<I", data[10:14]) + struct.unpack("<IiiHHI", data[14:34])
    if how:
        raise ValueError("a compressed BMP")
    up, h = h > 0, abs(h)
    rows = np.frombuffer(data, "u1", h * ((w * bits + 31) // 32 * 4), at).reshape(h, -1)
    if bits >= 24:
        out = rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack("<I", data[46:50])[0] or 1 << bits
        palette = np.frombuffer(data, "u1", 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = rows if bits == 8 else np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
        out = palette[index[:, :w]]
        if (palette[:, :1] == palette).all():
            out = out[:, :, 0]
    return out[::-1] if up else out


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, as floats: differences of the integral image, which is summed up only at the rows that are needed."""
    grey = image if image.ndim == 2 else image.mean(axis=2)

    def edges(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        e = np.arange(k + 1) * n / k
        whole = np.minimum(e.astype("i8"), n - 1)
        return whole, e - whole

    y, fy = edges(grey.shape[0], height)
    x, fx = edges(grey.shape[1], width)
    cuts = np.unique(np.concatenate([[0], y]))
    sums = np.add.reduceat(grey, cuts, axis=0, dtype="f8")
    above = np.concatenate([np.zeros((1, grey.shape[1])), np.cumsum(sums, axis=0)])[np.searchsorted(cuts, y)]
    rows = above + fy[:, None] * grey[y]
    across = np.concatenate([np.zeros((height + 1, 1)), np.cumsum(rows, axis=1)], axis=1)[:, x] + fx * rows[:, x]
    area = grey.shape[0] * grey.shape[1] / (height * width)
    return np.diff(np.diff(across, axis=0), axis=1) / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8 by 9 reduction is darker than the one on its right."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.clip(np.rint(area_resize(image, size, size)), 0, 255).astype("u1"), allow_pickle=False)
    return out.getvalue()


def bytes_image(data: bytes) -> np.ndarray:
    """Bytes as a grey image, filled up with 255 to a positive multiple of BLOCK."""
    whole = max(1, -(-len(data) // BLOCK)) * BLOCK
    return np.frombuffer(data + b"\xff" * (whole - len(data)), "u1").reshape(-1, WIDTH)


def _encode(form: str):
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
        for texts in batches:
            yield pd.Series([make(bytes_image((t or "").encode("utf-8", "surrogatepass"))) for t in texts], dtype=object)

    return F.pandas_udf(encode, "binary").asNondeterministic()


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for media in batches:
        rows = []
        for data in media:
            if data is None:
                rows.append((None,) * len(names))
                continue
            data = bytes(data)
            try:
                image = decode(data)
                if not image.size:
                    raise ValueError("an image without pixels")
            except (ValueError, IndexError, struct.error) as e:  # a broken image is that row's fault
                rows.append((None,) * (len(names) - 1) + (f"{type(e).__name__}: {e}",))
                continue
            payload = image.tobytes()
            rows.append((image.shape[1], image.shape[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), npy_tile(image), None))
        yield pd.DataFrame(rows, columns=names)


def text_media(docs: DataFrame, text: str = "text", form: str = "pgm") -> DataFrame:
    """docs without the text, with n_bytes and media (binary): the text's bytes as an image. Null text: as empty. Equal texts, repeated rows too, get equal images; an empty table stays empty. Columns named like an output are replaced."""
    bound_batches(docs.sparkSession)
    own = enclose(docs)
    t = F.col(f"in_{text}")
    own = own.withColumns({"n_bytes": F.octet_length(F.coalesce(t, F.lit(""))).cast("long"), "media": _encode(form)(t)})
    return release(own.drop(f"in_{text}"), ["n_bytes", "media"])


def media_features(df: DataFrame, media: str = "media") -> DataFrame:
    """df with the features of an image column: size, digests of samples and stored bytes, difference hash and NPY tile. Null media: nulls. Media that can't be decoded: nulls, and the reason in fault. Equal media get equal features; an empty table stays empty. Columns named like an output are replaced."""
    own = enclose(df).withColumn("_f", F.pandas_udf(_features, FEATURES).asNondeterministic()(F.col(f"in_{media}")))
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return release(own.select("*", *[F.col(f"_f.{n}").alias(n) for n in names]), names)


def write_tiles(df: DataFrame, path: str | None = None, media: str = "media") -> DataFrame:
    """The features of an image column (media_features) with their NPY tiles, written as Parquet to `path` (a scratch table, if None) and read back, without the media."""
    found = media_features(df, media).drop(media)
    if path is None:
        return materialise(found, "tiles")
    found.write.parquet(path)
    return df.sparkSession.read.schema(found.schema).parquet(path)


def read_tile(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is made of the stored hash and tile."""
    stored = materialise(text_media(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    tiles = write_tiles(stored)
    discard(stored)
    feature = F.concat_ws("-", "dhash", F.hex(F.crc32("tile")))
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
