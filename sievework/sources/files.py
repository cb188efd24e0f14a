"""Sources over directories, CSV, landmark and mask files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths


def scan(spark: SparkSession, folder: str, recursive: bool = False, suffixes: tuple[str, ...] = paths.IMAGE_SUFFIXES) -> DataFrame:
    """(path, length, modificationTime) of the pictures in a folder; none if there is no folder.

    Contents are not read: the column is pruned. Listings have no order; sort by path where it
    counts.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where(paths.is_image(F.col("path"), suffixes)).select("path", "length", "modificationTime")


def folders(spark: SparkSession, folder: str, recursive: bool = False) -> list[str]:
    """The names of the folders in a folder, in order; with recursive the paths of all below it. A
    listing by the file system, on the driver: folders are few where files are many."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [top] if system.exists(top) else []
    while todo:
        for status in system.listStatus(todo.pop()):
            if status.isDirectory():
                found.append(status.getPath().toUri().getPath() if recursive else status.getPath().getName())
                todo += [status.getPath()] if recursive else []
    return sorted(found)


def unique_stems(df: DataFrame, path: str, ties: list[str] | None = None) -> DataFrame:
    """The first row by path of each stem. An aggregate, so that a hot stem is combined early."""
    row = F.struct(path, *(ties or []), *[c for c in df.columns if c != path and c not in (ties or [])])
    first = df.groupBy(paths.stem(F.col(path)).alias("_stem")).agg(F.min(row).alias("_row"))
    return first.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def starting_with(df: DataFrame, path: str, text: str) -> DataFrame:
    return df.where(F.startswith(paths.name(F.col(path)), F.lit(text)))


def first_by_stem(df: DataFrame, path: str, stem: str) -> DataFrame:
    return df.where(paths.stem(F.col(path)) == stem).agg(F.min(path).alias(path))


def newest_first(df: DataFrame) -> DataFrame:
    """Adds age: 0 for the file changed last."""
    return df.withColumn("age", F.row_number().over(Window.orderBy(F.desc("modificationTime"), "path")) - 1)


def face_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, l, t, r, b) from a CSV with FILE, FACE_X, FACE_Y, FACE_WIDTH, FACE_HEIGHT; malformed
    lines are dropped."""
    kinds = "FILE string, FACE_X int, FACE_Y int, FACE_WIDTH int, FACE_HEIGHT int"
    rows = spark.read.schema(kinds).csv(path, header=True, mode="DROPMALFORMED")
    x, y = F.col("FACE_X"), F.col("FACE_Y")
    return rows.select(F.col("FILE").alias("file"), x.alias("l"), y.alias("t"), (x + F.col("FACE_WIDTH")).alias("r"), (y + F.col("FACE_HEIGHT")).alias("b"))


def box_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, l, t, w, h) from a quoted CSV with a header."""
    kinds = "name string, l int, t int, w int, h int"
    return spark.read.schema(kinds).csv(path, header=True, quote='"', ignoreLeadingWhiteSpace=True, mode="DROPMALFORMED")


def landmark_files(spark: SparkSession, folder: str, points: int = 68) -> DataFrame:
    """(path, landmarks) from text files: the lines between braces, exactly as many as there are
    points, or without braces the first lines that are two numbers. Other files give null."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    braced = F.contains("value", F.lit("{"))
    block = F.when(braced, F.regexp_extract("value", r"(?s)\{(.*?)\}", 1)).otherwise(F.col("value"))
    number = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: F.trim(x) != "")
    good = F.filter(lines, lambda x: F.rlike(F.trim(x), F.lit(rf"^{number}\s+{number}$")))
    whole = F.size(good) == F.size(lines)
    used = F.when(braced & whole & (F.size(good) == points), good).when(~braced & (F.size(good) >= points), F.slice(good, 1, points))
    return files.select("path", F.transform(used, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("double"))).alias("landmarks"))


def mask_files(df: DataFrame, path: str) -> DataFrame:
    """(id, mask_type, path) of files named after both; others are left out."""
    return df.select(paths.id_and_mask(F.col(path)).alias("m"), path).where("m IS NOT NULL").select("m.*", path)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data): decoded pictures; files that are none are left out."""
    image = spark.read.format("image").option("dropInvalid", True).load(folder)
    return image.select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data").withColumnRenamed("origin", "path")


def streams(probe: DataFrame) -> DataFrame:
    """The first video and the first audio stream of each file, from a table of its streams."""
    first = probe.where(F.col("codec_type").isin("video", "audio")).groupBy("path", "codec_type")
    return first.agg(F.min(F.struct("index", "r_frame_rate")).alias("s")).select("path", "codec_type", "s.*")
