"""Pictures: decode, crop, shrink, perceptual hash, and the columns they fill.

PNG is decoded here; JPEG and WebP need Pillow, where it is installed. Without it such pictures count as
unreadable, or come decoded from Spark's image source (hash_pictures).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.config import EngineConfig
from samefold.sources.embedding import BATCH, EmbeddingError, EmbeddingProvider

try:
    from PIL import Image, ImageOps
except ImportError:
    Image = None

MAX_SIDE, EMBED_SIDE = 1024, 384
WHITE = 247
MAX_UPLOAD, MAX_REMOTE = 5 << 20, 10 << 20
UNAVAILABLE = "image_layer_unavailable"


def format_of(content: bytes) -> str:
    """'PNG', 'JPEG', 'WEBP', or '' for what isn't taken."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return "PNG"
    if content[:3] == b"\xff\xd8\xff":
        return "JPEG"
    return "WEBP" if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else ""


def _png(content: bytes) -> np.ndarray:
    """Rows of 8 bits a sample, without interlacing; transparent pixels keep their colour."""
    at, head, palette, packed = 8, None, None, []
    while at + 8 <= len(content):
        size, name = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        at += size + 12
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("this kind of PNG isn't read")
    width, height, kind = head[0], head[1], head[3]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.uint8)
    for y in range(height):
        how, line = raw[y, 0], raw[y, 1:]
        if how == 0:
            row = line
        elif how == 2:
            row = line + above
        elif how == 1:  # each byte adds to the one a pixel before: a running sum by sample
            row = np.cumsum(line.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
        else:
            row = np.zeros(width * n, np.uint8)
            for x in range(width * n):
                a, b, c = (int(row[x - n]), int(above[x]), int(above[x - n])) if x >= n else (0, int(above[x]), 0)
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                row[x] = (int(line[x]) + guess) & 255
        out[y], above = row, row
    grid = out.reshape(height, width, n)
    if kind == 3:
        if palette is None:
            raise ValueError("the PNG has no palette")
        return palette[grid[..., 0]]
    return grid[..., :3] if n >= 3 else np.repeat(grid[..., :1], 3, axis=2)


def decode(content: bytes) -> np.ndarray:
    """Red, green, blue, turned as its EXIF says. ValueError for what isn't a picture of a known format."""
    kind = format_of(content)
    if not kind:
        raise ValueError("unsupported picture format")
    try:
        if Image is not None:
            from io import BytesIO

            return np.asarray(ImageOps.exif_transpose(Image.open(BytesIO(content))).convert("RGB"))
        if kind == "PNG":
            return _png(content)
    except Exception as e:  # codecs raise whatever they like
        raise ValueError(f"unreadable picture: {e}") from e
    raise ValueError(f"{kind} can't be read without Pillow")


def encode(rgb: np.ndarray, side: int = EMBED_SIDE) -> bytes:
    """The cropped picture for an embedding backend, shrunk to `side`, as PNG."""
    small = shrink(rgb, side)
    rows = np.concatenate((np.zeros((small.shape[0], 1), np.uint8), small.reshape(small.shape[0], -1)), axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", small.shape[1], small.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def digest(content: bytes) -> str:
    """Tells whether a picture has changed."""
    return hashlib.sha1(content, usedforsecurity=False).hexdigest()


def probe() -> bytes:
    """A tiny picture for handshakes."""
    return encode(np.full((8, 8, 3), 128, np.uint8))


def luminance(rgb: np.ndarray) -> np.ndarray:
    """ITU-R 601 luma in whole numbers."""
    w = rgb[..., :3].astype(np.int64) @ np.array([19595, 38470, 7471])
    return ((w + 0x8000) >> 16).astype(np.uint8)


def crop(rgb: np.ndarray) -> np.ndarray:
    """The bounding box of what isn't near white; a white picture stays."""
    ink = luminance(rgb) < WHITE
    if not ink.any():
        return rgb
    rows, cols = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    return rgb[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]


def _weights(size: int, to: int) -> np.ndarray:
    """Lanczos-3 resampling of a line of `size` to `to`."""
    scale = max(size / to, 1.0)
    centre = (np.arange(to) + 0.5) * size / to
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(grid: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.tensordot(_weights(grid.shape[0], height), grid.astype(float), 1)
    out = np.moveaxis(np.tensordot(_weights(grid.shape[1], width), np.moveaxis(out, 1, 0), 1), 0, 1)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def shrink(rgb: np.ndarray, side: int = MAX_SIDE) -> np.ndarray:
    h, w = rgb.shape[:2]
    if max(h, w) <= side:
        return rgb
    k = side / max(h, w)
    return resize(rgb, max(1, round(h * k)), max(1, round(w * k)))


def phash(rgb: np.ndarray) -> int:
    """64 bits as a signed number: 32 x 32 grey, cosine transform, low 8 x 8 against their median."""
    grey = resize(luminance(rgb), 32, 32).astype(float)
    k = np.arange(32)
    dct = 2 * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (dct @ grey @ dct.T)[:8, :8]
    bits = "".join("1" if v else "0" for v in (low > np.median(low)).ravel())
    raw = int(bits, 2)
    return raw - (1 << 64) if raw >> 63 else raw


def hash_pictures(images: DataFrame) -> DataFrame:
    """kind, ref, phash, image_sha1 from (kind, ref, sha1, height, width, channels, data), the pixels as
    Spark's image source decodes them (blue, green, red). Pictures it couldn't decode are absent."""

    def one(batches):
        for b in batches:
            out = []
            for kind, ref, sha1, h, w, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if data and h > 0 and w > 0:
                    grid = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    rgb = np.repeat(grid, 3, axis=2) if n == 1 else grid[..., [2, 1, 0]]
                    out.append((kind, ref, phash(shrink(crop(rgb))), sha1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["kind", "ref", "phash", "image_sha1"])

    picked = images.select("kind", "ref", "sha1", "height", "width", "channels", "data")
    return picked.mapInArrow(one, "kind string, ref string, phash long, image_sha1 string")


def needs_work(fps: DataFrame, digests: DataFrame, model_id: str) -> DataFrame:
    """kind, ref, sha1 of pictures that are new, changed, or embedded by another model."""
    both = digests.join(fps.select("kind", "ref", "image_sha1", "vec_model"), ["kind", "ref"])
    return both.where((F.col("image_sha1") != F.col("sha1")) | (F.col("vec_model") != model_id)).select("kind", "ref", "sha1")


def is_remote(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike("^https?://")


# ---- from bytes to columns


def stored_contents(spark: SparkSession, folder: str, paths: DataFrame) -> DataFrame:
    """kind, ref, content of pictures (kind, ref, image_path_or_url) that lie in a folder Spark reads; those
    over MAX_REMOTE bytes, and those that aren't there, are absent. The path's end after the folder counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= MAX_REMOTE)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    asked = paths.where(~is_remote(F.col("image_path_or_url"))).select("kind", "ref", F.regexp_extract("image_path_or_url", r"([^/]+)$", 1).alias("__name"))
    return asked.join(files.select(name.alias("__name"), "content"), "__name").select("kind", "ref", "content")


def fetched_contents(paths: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """The same of remote pictures. What can't be fetched is absent, so its row waits for the next run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, ref, url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    out.append((kind, ref, fetch(url)))
                except (OSError, ValueError):
                    continue
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)], ["kind", "ref", "content"])

    return paths.where(is_remote(F.col("image_path_or_url"))).select("kind", "ref", "image_path_or_url").mapInArrow(run, "kind string, ref string, content binary")


def _vectors(provider: EmbeddingProvider, pictures: list[bytes], dim: int) -> list[list[float] | None]:
    """A vector for each picture, or nulls where the backend fails."""
    out: list = []
    for at in range(0, len(pictures), BATCH):
        part = pictures[at : at + BATCH]
        try:
            found = provider.embed_images(part)
            if len(found) != len(part) or any(len(v) != dim for v in found):
                raise EmbeddingError("wrong number or length of vectors")
            out += found
        except EmbeddingError:
            out += [None] * len(part)
    return out


_PICTURE = "kind string, ref string, phash long, image_sha1 string, image_vec array<float>, vec_model string"


def refresh_pictures(fps: DataFrame, contents: DataFrame, make: Callable[[], EmbeddingProvider], model_id: str, dim: int) -> DataFrame:
    """kind, ref, phash, image_sha1, image_vec, vec_model of the pictures (kind, ref, content) that are new,
    changed or embedded by another model. A broken picture skips its row; without a vector the hash stands."""
    known = fps.select("kind", "ref", F.col("image_sha1").alias("old"), F.col("vec_model").alias("by"))
    todo = contents.where((F.length("content") > 0) & (F.length("content") <= MAX_REMOTE)).join(known, ["kind", "ref"])
    todo = todo.where((F.sha1("content") != F.coalesce("old", F.lit(""))) | (F.coalesce("by", F.lit("")) != model_id)).select("kind", "ref", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                good = []
                for kind, ref, content in zip(*(c.to_pylist() for c in whole.slice(at, BATCH).columns), strict=True):
                    try:
                        rgb = shrink(crop(decode(content)))
                    except ValueError:
                        continue
                    good.append((kind, ref, phash(rgb), digest(content), encode(rgb)))
                if not good:
                    continue
                kinds, refs, hashes, sums, encoded = zip(*good, strict=True)
                vectors = _vectors(provider, list(encoded), dim)
                models = [model_id if v is not None else None for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds), pa.array(refs), pa.array(hashes, pa.int64()), pa.array(sums), pa.array(vectors, pa.list_(pa.float32())), pa.array(models, pa.string())],
                    ["kind", "ref", "phash", "image_sha1", "image_vec", "vec_model"],
                )

    return todo.mapInArrow(run, _PICTURE)


def query_pictures(raw: DataFrame, config: EngineConfig, make: Callable[[], EmbeddingProvider], fetch: Callable[[str], bytes] | None) -> DataFrame:
    """Requests with phash, image_vec, model_id of their picture, and image_warnings.

    A picture comes as bytes (column `image`), else from image_url, else as a hash and vector of its own.
    With the image layer off, or a picture that can't be had or embedded, the rest of the request counts
    and UNAVAILABLE is the warning. Bytes that aren't a picture are the caller's mistake: a warning too."""
    none = F.array().cast("array<string>")
    empty = {"phash": F.lit(None).cast("long"), "image_vec": F.lit(None).cast("array<float>"), "model_id": F.lit(None).cast("string")}
    given = raw.withColumns({c: v for c, v in empty.items() if c not in raw.columns})
    if "image" not in raw.columns:
        given = given.withColumn("image", F.lit(None).cast("binary"))
    has = F.col("image").isNotNull() | (F.coalesce("image_url", F.lit("")) != "")
    if not config.image_enabled:
        off = F.when(has | F.col("phash").isNotNull() | F.col("image_vec").isNotNull(), F.array(F.lit(UNAVAILABLE))).otherwise(none)
        return given.withColumn("image_warnings", off).withColumns(empty).drop("image")
    model_id, dim = config.model_id, config.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = make()
        for b in batches:
            out = []
            for query_id, content, url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    if content is None:
                        if fetch is None:
                            raise ValueError("nothing to fetch pictures with")
                        content = fetch(url)
                    if len(content) > MAX_REMOTE:
                        raise ValueError("the picture is too large")
                    rgb = shrink(crop(decode(content)))
                except (OSError, ValueError):
                    out.append((query_id, None, None))
                    continue
                out.append((query_id, phash(rgb), _vectors(provider, [encode(rgb)], dim)[0]))
            if out:
                types = (pa.int64(), pa.int64(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["query_id", "__hash", "__vec"])

    seen = given.where(has).select("query_id", "image", "image_url").mapInArrow(run, "query_id long, __hash long, __vec array<float>")
    both = given.drop("image").join(seen.withColumn("__seen", F.lit(True)), "query_id", "left")
    new = F.coalesce("__seen", F.lit(False))
    return both.withColumns({
        "phash": F.when(new, F.col("__hash")).otherwise(F.col("phash")), "image_vec": F.when(new, F.col("__vec")).otherwise(F.col("image_vec")),
        "model_id": F.when(new, F.lit(model_id)).otherwise(F.col("model_id")), "image_warnings": F.when(new & F.col("__vec").isNull(), F.array(F.lit(UNAVAILABLE))).otherwise(none),
    }).drop("__hash", "__vec", "__seen")
