"""Readers of files as their makers leave them; every row of a file comes out, accepted or as a reject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import cut


def payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files of JSON documents, each file one document or an array of them over any number of lines.

    rows: entity_id, proposition_id, priority of every claim; a document without claims is one row without any.
    rejects: path and line (the file's text) of what does not parse.
    """
    shape = "entity long, claims array<struct<id: long, priority: string>>, line string"
    read = spark.read.schema(shape).option("multiLine", True).option("columnNameOfCorruptRecord", "line").json(path)
    read = cut(read.select("*", F.col("_metadata.file_path").alias("path")), "payloads")  # both results read what was parsed once
    c = read.where("line is null").select(F.col("entity").alias("entity_id"), F.explode_outer("claims").alias("c"))
    return c.select("entity_id", F.col("c.id").alias("proposition_id"), F.col("c.priority").alias("priority")), read.where("line is not null").select("path", "line")


def blobs(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """(name_of_blob, intact, in_ledger): whether the name of each blob's folder is the hash of its bytes as they are, and whether the ledger (sha) has it. Spark's file scans leave out files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    hashed = files.select(F.regexp_extract("path", r"sha=([0-9a-f]{64})", 1).alias("name_of_blob"), F.sha2("content", 256).alias("hash"))
    return _looked_up(hashed, ledger)


def packed_blobs(spark: SparkSession, path: str, ledger: DataFrame) -> DataFrame:
    """blobs of a folder of packs: columnar files with name and content (bytes) of many blobs each, as a file a blob is too many files to list and open."""
    hashed = spark.read.schema("name string, content binary").parquet(path).select(F.col("name").alias("name_of_blob"), F.sha2("content", 256).alias("hash"))
    return _looked_up(hashed, ledger)


def _looked_up(hashed: DataFrame, ledger: DataFrame) -> DataFrame:
    known = ledger.select(F.col("sha").alias("name_of_blob"), F.lit(True).alias("hit")).distinct()
    return hashed.join(known, "name_of_blob", "left").select("name_of_blob", (F.col("hash") == F.col("name_of_blob")).alias("intact"), F.coalesce("hit", F.lit(False)).alias("in_ledger"))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a delimited file with a header whose `geometry` is a simple polygon in text, with its ring and box."""
    rows = spark.read.csv(path, header=True)
    points = F.transform(F.split(F.regexp_extract("geometry", r"\(\(([^)]*)\)\)", 1), r",\s*"), lambda p: F.struct(F.element_at(F.split(p, " "), 1).cast("double").alias("x"), F.element_at(F.split(p, " "), 2).cast("double").alias("y")))
    rows = rows.withColumn("ring", points)
    edge = lambda c: F.transform("ring", lambda p: p[c])
    return rows.withColumns({"west": F.array_min(edge("x")), "east": F.array_max(edge("x")), "south": F.array_min(edge("y")), "north": F.array_max(edge("y"))})


def boxed(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of a columnar file whose box (xmin, xmax, ymin, ymax) meets the given one; geometry bytes pass through."""
    return spark.read.parquet(path).where((F.col("xmin") <= east) & (F.col("xmax") >= west) & (F.col("ymin") <= north) & (F.col("ymax") >= south))


def delimited(spark: SparkSession, path: str, schema: str, separator: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): the lines that fit the schema, and the others as `line`. Quotes within a field are doubled."""
    rows = spark.read.schema(f"{schema}, line string").option("sep", separator).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").csv(path)
    rows = cut(rows, "parsed")  # both results read what was parsed once
    return rows.where("line is null").drop("line"), rows.where("line is not null").select("line")
