"""Reading manifests, nested JSON, rule catalogues and binary files; admission of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline import schemas
from vetline.functions.text import sanitize_filename
from vetline.sources.digests import FileDigests, file_writer

# Fixed values of the admission check.
MAX_BYTES = 10 * 1024 * 1024
EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
JPEG_MAGIC, PNG_MAGIC, RIFF_MAGIC, WEBP_MARK = "FFD8FF", "89504E470D0A1A0A", "52494646", "57454250"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).csv(path, header=True, quote='"', escape='"')


def read_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The ``records`` of nested JSON documents, one row each. One document per file with
    ``multi_line``; one per line, which Spark can split, without."""
    docs = spark.read.schema(schemas.RECORDS).json(path, multiLine=multi_line)
    return docs.select("version", F.inline("records"))


def read_rules(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    docs = spark.read.schema(schemas.RULES).json(path, multiLine=multi_line)
    return docs.select("document_type", "version", F.inline("rules"))


def inventory(spark: SparkSession, paths: list[str], extensions: list[str] = EXTENSIONS) -> DataFrame:
    """All files below the paths with one of the extensions: name, size and digest."""
    glob = "*.{" + ",".join(e for x in extensions for e in (x, x.upper())) + "}"
    return digests(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths))


def chunked_inventory(spark: SparkSession, paths: list[str], extensions: list[str] = EXTENSIONS, chunk: int = 8 << 20) -> DataFrame:
    """``inventory`` for files of any size: each is hashed ``chunk`` bytes at a time where it is read, none is a value."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("paths", "\n".join(paths)).option("extensions", "\n".join(extensions)).option("chunk", str(chunk)).load()


def write_files(rows: DataFrame, base: str, name: str = "name", content: str = "content") -> int:
    """Each row's bytes as a file of its own below ``base``; returns their number. Names must differ.

    Tasks write the files in place: the committer of a table would make, move and list a folder for each of them, the moves
    one after the other on the driver.
    """
    named = rows.select(name, F.col(content).cast("binary"))
    return named.mapInArrow(file_writer(base), "files bigint").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def digests(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Name, size and digest of the files of any table that holds their bytes."""
    return files.select(F.substring_index(path, "/", -1).alias("filename"), F.col(path).alias("path"),
                        F.length(content).cast("bigint").alias("length"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def _media_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    return (F.when(head.startswith(JPEG_MAGIC), "image/jpeg").when(head.startswith(PNG_MAGIC), "image/png")
            .when(head.startswith(RIFF_MAGIC), "image/webp"))


def admit(files: DataFrame, name: str = "filename", content: str = "content") -> DataFrame:
    """Reason a file is refused, or its media type: size, extension of the cleaned name, first bytes."""
    size = F.length(content)
    clean = F.lower(sanitize_filename(F.col(name)))
    extension = F.when(clean.contains("."), F.substring_index(clean, ".", -1)).otherwise("")
    media = _media_type(F.col(content))
    reason = (F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY").when(size > MAX_BYTES, "TOO_LARGE")
              .when(~extension.isin(*EXTENSIONS), "EXTENSION").when(media.isNull(), "CONTENT"))
    return files.withColumns({"refused": reason, "media_type": F.when(reason.isNull(), media)})
