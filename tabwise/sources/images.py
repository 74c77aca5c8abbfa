"""Image folders as DataFrames (A14, M3, M4), and rows of pixels as image files.

Files are listed and decoded by Spark's own sources (``binaryFile`` and
``image``: JVM decoding, no Python imaging library), one row per file, in
parallel over the folder tree.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.functions.predicates import label_from_filename

# fixed values: accepted image file extensions
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "bmp", "webp"]


class NoImages(ValueError):
    pass


def scan_images(spark: SparkSession, root: str, require: bool = True) -> DataFrame:
    """``(path, relative_path, label)`` for every image file below
    ``root`` (extension filter; label from the name / parent folder)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "length"))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.filter(ext.isin(*IMAGE_EXTENSIONS))
    base = root.rstrip("/")
    rel = F.regexp_replace("path", r"^(file:)?" + base.replace(".", r"\.") + "/", "")
    out = files.select("path", rel.alias("relative_path"), label_from_filename(F.col("path")).alias("label"))
    if require and out.limit(1).count() == 0:
        raise NoImages(f"no image files found below {root}")
    return out


def load_images(spark: SparkSession, root: str, drop_invalid: bool = False) -> DataFrame:
    """M3 / M4: decoded images ``(path, height, width, nChannels, mode,
    data)``; with ``drop_invalid=False`` undecodable files stay as rows with
    height -1 (BGR byte order, as Spark decodes)."""
    df = (spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True)
          .load(root))
    ext = F.lower(F.regexp_extract("image.origin", r"\.([A-Za-z0-9]+)$", 1))
    df = df.filter(ext.isin(*IMAGE_EXTENSIONS))
    return df.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels",
                     "image.mode", "image.data")


def validate_images(images: DataFrame) -> DataFrame:
    """M3: ``(valid, rejected, total)`` counts; valid rows keep their data."""
    ok = F.col("height") > 0
    return images.agg(F.sum(F.when(ok, 1).otherwise(0)).alias("valid"),
                      F.sum(F.when(ok, 0).otherwise(1)).alias("rejected"),
                      F.count(F.lit(1)).alias("total"))


def encode_png(pixels: bytes, width: int, height: int, channels: int = 3) -> bytes:
    """An 8-bit PNG (1 gray, 3 RGB or 4 RGBA channels) of rows of pixels."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    stride = width * channels
    rows = b"".join(b"\0" + pixels[i * stride:(i + 1) * stride] for i in range(height))
    color = {1: 0, 3: 2, 4: 6}[channels]
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def write_images(images: DataFrame, root: str) -> int:
    """One file per row of ``images`` (relative_path, width, height, channels,
    pixels) below ``root``, a folder that the executors share; the number of
    files. Too few pixels are written as they are, none as one zero byte (files
    that nothing decodes; a scan would pass over an empty one). A task that runs again writes the same
    files, so lost executors do no harm."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                store, path = FileSystem.from_uri(f"{root.rstrip('/')}/{r.relative_path}")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                data = r.pixels or b"\0"
                if r.pixels and len(data) == r.width * r.height * r.channels:
                    data = encode_png(data, int(r.width), int(r.height), int(r.channels))
                with store.open_output_stream(path) as out:
                    out.write(data)
            yield pd.DataFrame({"n": [len(b)]})
    made = images.select("relative_path", "width", "height", "channels", "pixels").mapInPandas(run, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
