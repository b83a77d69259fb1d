"""Routing of input files and reading of pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom import constants as K

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route_by_suffix(path: Column) -> Column:
    """vector, raster or NULL: needs no file content."""
    s = suffix_of(path)
    return F.when(s.isin(*K.VECTOR_SUFFIXES), "vector").when(s.isin(*K.RASTER_SUFFIXES), "raster")


def route_by_content(content: Column) -> Column:
    """vector, raster or NULL from the first 1024 bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    # byte-aligned search: hex digits come in pairs
    marked = head.rlike(f"^(?:..)*?{K.PDF_MARK_HEX}")
    raster = F.lit(False)
    for magic, _ in K.MAGIC_HEX:
        raster = raster | head.startswith(magic)
    return F.when(marked, "vector").when(raster, "raster")


def route_files(files: DataFrame) -> DataFrame:
    """(path, route, problem): suffix first, then leading bytes, never a guess.

    Only files whose suffix says nothing have their content looked at; the
    content itself is not passed on.
    """
    named = route_by_suffix(F.col("path"))
    route = F.coalesce(named, F.when(named.isNull(), route_by_content(F.col("content"))))
    return files.select("path", route.alias("route")).withColumn(
        "problem", F.when(F.col("route").isNull(), "no route: neither the suffix nor the first bytes name a "
                          "supported document or picture"))


def read_routes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(routed files, quarantined files) of a folder, in two scans: names only
    for known suffixes, content only for the rest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    by_name = files.select("path", route_by_suffix(F.col("path")).alias("route")).where(
        F.col("route").isNotNull()).withColumn("problem", F.lit(None).cast("string"))
    rest = route_files(files.where(route_by_suffix(F.col("path")).isNull()))
    return by_name.unionByName(rest.where(F.col("route").isNotNull())), rest.where(F.col("route").isNull())


def image_pixels(images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., y, x, b, g, r) from an image column; BGR byte order.

    Rows are cut next to the scan: one exploded row per image line, then one
    per pixel, so that reductions run before anything is shuffled.
    """
    img = F.col("image")
    stride = F.col("w") * F.col("ch")
    lines = (images.select(*keys, img["width"].alias("w"), img["nChannels"].alias("ch"),
                           img["data"].alias("data"), F.explode(F.sequence(F.lit(0), img["height"] - 1)).alias("y"))
             .withColumn("line", F.hex(F.expr("substring(data, y * w * ch + 1, w * ch)"))).drop("data"))
    pixels = lines.select(*keys, "y", "ch", "line", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))

    def channel(i):
        at = F.when(F.col("ch") == 1, F.lit(0)).otherwise(F.lit(i))
        pos = (F.col("x") * F.col("ch") + at) * 2 + 1
        return F.conv(F.substring(F.col("line"), pos, F.lit(2)), 16, 10).cast("int")

    return pixels.select(*keys, "y", "x", channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))


def read_pixels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pixels by sheet_id = origin, unreadable files)."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(folder)
    ok = (F.col("image.width") > 0) & (F.col("image.height") > 0)
    good = raw.where(ok).withColumn("sheet_id", F.col("image.origin"))
    bad = raw.where(~ok | ok.isNull()).select(F.col("image.origin").alias("path"),
                                              F.lit("could not read image").alias("problem"))
    return image_pixels(good, ["sheet_id"]), bad
