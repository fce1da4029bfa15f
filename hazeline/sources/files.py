"""Image-sequence names, sequence manifests and label files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hazeline.session import materialize


def offset_of(path: Column) -> Column:
    """Seconds in a name like 1465063200_-02400.jpg; 0 where the name has none."""
    return F.coalesce(F.regexp_extract(path, r"(?i)_([+-]?\d+)\.(?:jpg|jpeg|png)$", 1).try_cast("int"), F.lit(0))


def timed(images: DataFrame) -> DataFrame:
    """images(path) with folder and offset_s: parsed seconds, or the place in name order where a folder's are all 0."""
    x = images.where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")).withColumns({"folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "parsed": offset_of(F.col("path"))})
    own = Window.partitionBy("folder")
    place = F.row_number().over(own.orderBy("path")) - 1
    return x.withColumn("offset_s", F.when(F.max(F.abs("parsed")).over(own) > 0, F.col("parsed")).otherwise(place).cast("double")).drop("parsed")


def image_sequences(spark: SparkSession, folder: str, cap: int | None = None) -> DataFrame:
    """path, content, folder, offset_s of the images below a folder, at most cap a folder in order of offset. Offsets come from
    the paths alone; only these small rows are shuffled, and the bytes meet them without one. Files that can't be read are
    left out."""
    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(folder)
    place = timed(images.select("path"))
    if cap is not None:
        place = place.withColumn("_nth", F.row_number().over(Window.partitionBy("folder").orderBy("offset_s", "path"))).where(F.col("_nth") <= cap).drop("_nth")
    place = materialize(place, "image-places")
    rows = place.count()
    return images.select("path", "content").join(F.broadcast(place) if rows <= 1_000_000 else place, "path")


def sources(spark: SparkSession, path: str) -> DataFrame:
    """A sequence by what path is: a manifest (.json) or a folder of images."""
    return manifest(spark, path) if path.lower().endswith(".json") else image_sequences(spark, path)


def manifest(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """(sequence, file, offset_s, frame_index) of a JSON manifest, frames numbered by offset; of files(path), if given, only
    frames whose file is there, as <folder of the manifest>/<sequence>/<file>. Sequences without frames give no rows."""
    schema = "sequence string, frames array<struct<file: string, offset_s: int>>"
    x = spark.read.schema(schema).json(path, multiLine=True).select("sequence", F.explode("frames").alias("f")).select("sequence", "f.file", "f.offset_s")
    if files is not None:
        root = path.rsplit("/", 1)[0]
        x = x.withColumn("path", F.concat_ws("/", F.lit(root), "sequence", "file")).join(files.select(F.regexp_replace("path", "^file:/*", "/").alias("path")), "path", "left_semi").drop("path")
    return x.withColumn("frame_index", F.row_number().over(Window.partitionBy("sequence").orderBy("offset_s", "file")) - 1)


def image_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, image, label, partner, camera, date) of a JSON list of images."""
    return spark.read.schema("name string, image string, label string, partner string, camera string, date string").json(path, multiLine=True)


def labelled_images(spark: SparkSession, images: DataFrame, folder: str) -> DataFrame:
    """images(label, width, height, ...) with the box of each line of their label files below a folder: x1, y1, x2, y2, one
    row a box. An image whose file is missing or empty keeps one row with nulls."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("_file"))
    asked = images.withColumn("_file", F.concat_ws("/", F.lit(folder.rstrip("/")), "label"))
    found = boxes(lines.join(asked.select("_file", "width", "height").distinct(), "_file"), F.col("width"), F.col("height"), keep=["_file"])
    return asked.join(found, "_file", "left").drop("_file")


def safe_name(name: Column) -> Column:
    """Whether a file name stays within its folder: not empty, no separators, no two dots in a row."""
    return F.coalesce((F.length(name) > 0) & ~name.rlike(r"[/\\]|\.\."), F.lit(False))


def pre_ignition(frames: DataFrame) -> DataFrame:
    """Frames of the sequences that have one before ignition."""
    return frames.join(frames.groupBy("sequence").agg(F.bool_or(F.col("offset_s") < 0).alias("ok")).where("ok").select("sequence"), "sequence", "left_semi")


def boxes(lines: DataFrame, width: float | Column, height: float | Column, keep: list[str] | None = None) -> DataFrame:
    """Corners in pixels from label lines(value) `class cx cy w h` in shares of the image, with the columns to keep; lines with
    fewer tokens are skipped."""
    t = F.split(F.trim("value"), r"\s+")
    n = lines.withColumn("_t", t).where(F.size("_t") >= 5).select("*", *(F.col("_t")[i].try_cast("double").alias(c) for i, c in enumerate(("_c", "_x", "_y", "_w", "_h"))))
    at = lambda c, s, side, sign: (F.col(c) + sign * F.col(s) / 2) * side
    return n.select(*(keep or []), at("_x", "_w", width, -1).alias("x1"), at("_y", "_h", height, -1).alias("y1"), at("_x", "_w", width, 1).alias("x2"), at("_y", "_h", height, 1).alias("y2"))
