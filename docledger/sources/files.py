"""Scans of files by extension, with metadata and content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as an image, at large and in a strict selection.
IMAGES = ("jpg", "jpeg", "png", "bmp", "tiff", "webp", "gif")
STRICT = ("png", "jpg", "jpeg", "webp")
#: Files of up to WHOLE bytes are read as one value, longer ones by BLOCK bytes.
WHOLE, BLOCK = 1 << 28, 1 << 23


def scan(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...] = IMAGES, recursive: bool = True) -> DataFrame:
    """path, name, extension, length, modificationTime, content of files by extension in any case, in
    the order of their paths. Paths that do not exist are skipped: if none does, there are no rows. What is
    not selected is not read: without ``content`` only the listing is."""
    there = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if there:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(there)
    else:
        found = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return found.select("path", name.alias("name"), extension.alias("extension"), "length", "modificationTime", "content").where(F.col("extension").isin(*extensions)).orderBy("path")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def digests(files: DataFrame) -> DataFrame:
    """name, digest: SHA-256 of the content, or of the path where there is none. A file of more than WHOLE bytes
    is read by blocks in the task that holds its path, whatever its size."""
    whole = files.where(F.col("length") <= WHOLE).select("name", F.sha2(F.coalesce("content", F.col("path").cast("binary")), 256).alias("digest"))
    return whole.unionByName(files.where(F.col("length") > WHOLE).select("path", "name").mapInArrow(_by_blocks, "name string, digest string"))


def _by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for path in b.column(0).to_pylist():
            local = path.removeprefix("file:") if path.startswith("file:") else None
            fs, at = (LocalFileSystem(), "/" + local.lstrip("/")) if local else FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with fs.open_input_stream(at) as f:
                while block := f.read(BLOCK):
                    digest.update(block)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.string())], ["name", "digest"])


def digests_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """name, digest for each of the given paths of files: of the content, or where there is no such file, of the path
    as it was given."""
    there = [p for p in paths if exists(spark, p)]
    found = digests(spark.read.format("binaryFile").load(there).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")) if there else None
    lost = spark.createDataFrame([(p,) for p in paths if p not in set(there)], "path string").select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("path", 256).alias("digest"))
    return found.unionByName(lost) if found else lost
