"""Files as sources: content-addressed blobs and document manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "name string, url string, sha256 string, bytes long, pages int, has_text_layer boolean, median_chars_per_page int, content_starts_on_pdf_page int, index_pages array<int>, "
    "sections array<struct<code: string, title: string, printed_page: int, pdf_start: int, pdf_end: int, pages: int, boundary_source: string, note: string>>"
)


def blob_files(spark: SparkSession, root: str) -> DataFrame:
    """(digest, path, length, content) of the files under a blob root; names that are no digests are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("digest"), "path", "length", "content").where(F.col("digest").rlike("^[0-9a-f]{64}$"))


def read_range(blobs: DataFrame, start: int, length: int) -> DataFrame:
    """blobs with the bytes [start, start + length) of each."""
    return blobs.withColumn("part", F.expr(f"substring(content, {start + 1}, {length})"))


def corrupt(blobs: DataFrame) -> DataFrame:
    """Blobs whose content isn't what their name says."""
    return blobs.where(F.sha2("content", 256) != F.col("digest"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Document manifests, one JSON object a file; unknown fields are ignored."""
    return spark.read.schema(MANIFEST).option("multiLine", "true").json(path)


def manifest_sections(found: DataFrame) -> DataFrame:
    """One row per section."""
    return found.select("name", F.col("pages").alias("document_pages"), F.explode("sections").alias("s")).select("name", "document_pages", "s.*")
