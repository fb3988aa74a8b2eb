"""Readers and writers of the system's inputs, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "timestamp timestamp, level string, service string, message string"
ARTICLE = "articleId string, title string, content string, tags array<string>, createdAt timestamp, updatedAt timestamp, author string"
TICKET = "ticketId string, subject string, description string, priority string, createdAt timestamp, attachments array<string>, status string, conversation array<struct<messageId string, source string, content string, timestamp timestamp, type string>>"
VECTOR = "id string, vector array<float>"
METADATA = "id string, source string, type string, filePath string, startLine int, endLine int, content string, language string, repositoryNamespace string, description string, purposeSummary string, capabilities array<string>, usageExamples array<string>"
# Fixed values.
CODE_SUFFIXES = ("java", "py", "js", "ts", "jsx", "tsx", "html", "xml", "properties", "yml", "yaml", "json", "sql", "c", "cpp", "h", "cs", "go", "rs", "kt", "kts", "groovy", "scala", "rb", "php")
#: Suffixes of a plain search of files.
SEARCH_SUFFIXES = ("java", "js", "ts", "jsx", "tsx", "py", "xml", "json", "yml", "yaml", "properties", "sh", "md", "html", "css", "scss")
EXCLUDED_FOLDERS = ("node_modules", "target", "build", "dist", ".git", ".idea", ".vscode")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object for each line; lines that don't parse are left out."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file for each article; of equal ids the last file's counts."""
    rows = spark.read.schema(ARTICLE).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    order = Window.partitionBy("articleId").orderBy(F.desc("file"))
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r", "file")


def tickets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TICKET).option("multiLine", True).json(path)


def ticket_messages(found: DataFrame) -> DataFrame:
    return found.select("ticketId", F.posexplode("conversation").alias("position", "m")).select("ticketId", "position", "m.*")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, namespace): vector files below one folder for each namespace."""
    rows = spark.read.schema(VECTOR).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("namespace", F.element_at(F.split("_metadata.file_path", "/"), -2))


def metadata(spark: SparkSession, path: str, held: DataFrame) -> DataFrame:
    """Metadata rows with a source whose vector exists."""
    return spark.read.schema(METADATA).option("multiLine", True).json(path).where("source is not null").join(held.select("id"), "id", "left_semi")


def code(spark: SparkSession, path: str, suffixes: tuple[str, ...] = CODE_SUFFIXES) -> DataFrame:
    """(path, content) of source files; hidden files and build folders are left out."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    name = F.substring_index("path", "/", -1)
    inside = F.exists(F.split("path", "/"), lambda p: p.isin(*EXCLUDED_FOLDERS))
    return rows.where(F.lower(F.substring_index(name, ".", -1)).isin(*suffixes) & ~name.startswith(".") & ~inside)


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of property files."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("v"))
    rows = rows.where(F.lower("file").endswith(".properties") & ~F.col("v").rlike("^[#!]") & F.col("v").contains("="))
    return rows.select("file", F.trim(F.substring_index("v", "=", 1)).alias("key"), F.trim(F.regexp_replace("v", "^[^=]*=", "")).alias("value"))


def write_by(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
