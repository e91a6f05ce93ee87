"""Sources: registering files and reading texts. What is made of them is kept by `store`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Accepted extensions and MIME types, and the largest file.
TYPES = {"pdf": "pdf", "doc": "docx", "docx": "docx", "txt": "txt", "md": "md", "markdown": "md"}
MIMES = {"application/pdf": "pdf", "application/msword": "docx", "text/plain": "txt", "text/markdown": "md"}
MOST_BYTES = 100 << 20


def register_documents(files: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """files: name, content (binary), mime, category, tags, access_level -> new registry rows and rejects with a reason.

    The type comes from the extension after the last dot, else from the MIME type. Of equal contents the first name
    stays; contents that the registry has are left out."""
    lookup = lambda of, key: F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), key)
    extension = F.when(F.col("name").contains("."), F.lower(F.substring_index("name", ".", -1))).otherwise("")
    size = F.octet_length("content")
    rows = files.withColumn("doc_type", F.coalesce(lookup(TYPES, extension), lookup(MIMES, F.lower("mime")))).withColumn("size", size)
    reason = F.when(F.col("doc_type").isNull(), "type").when(F.coalesce("size", F.lit(0)) == 0, "empty").when(F.col("size") > MOST_BYTES, "size")
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason is null").withColumn("content_hash", F.sha2("content", 256))
    at = F.row_number().over(Window.partitionBy("content_hash").orderBy("name"))
    good = good.withColumn("at", at).filter("at = 1")
    if registry is not None:
        good = good.join(registry.select("content_hash"), "content_hash", "left_anti")
    metadata = F.map_filter(F.create_map(F.lit("category"), F.col("category"), F.lit("tags"), F.col("tags"), F.lit("accessLevel"), F.col("access_level")), lambda _, v: v.isNotNull())
    return good.select(F.col("content_hash").alias("id"), F.col("name").alias("title"), "doc_type", "size", "content_hash", F.lit("PENDING").alias("status"), metadata.alias("metadata")), rows.filter("reason is not null").select("name", "reason")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_type (unknown suffixes: txt), content (normalized), heading structure of Markdown files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    suffix = F.lower(F.substring_index("path", ".", -1))
    kind = F.when(suffix.isin("md", "markdown"), "md").otherwise("txt")
    content = tx.normalize(F.col("value"))
    return rows.select("path", kind.alias("doc_type"), content.alias("content"), F.when(kind == "md", tx.markdown(content)["headings"]).alias("headings"))
