"""Sets of records as Parquet: packing, metadata saved and restored. Inputs are never deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.joins import missing, restored

FACES = """filename string, sample_type int, face_type string, shape struct<h:int,w:int,c:int>,
    landmarks array<array<double>>, source_landmarks array<array<double>>, source_filename string,
    source_rect struct<l:int,t:int,r:int,b:int>, image_to_face_mat array<array<double>>, eyebrows_expand_mod double,
    seg_ie_polys array<struct<type:int,pts:array<array<float>>>>, xseg_mask binary, person_name string,
    pitch_yaw_roll struct<pitch:double,yaw:double,roll:double>"""


def with_defaults(df: DataFrame) -> DataFrame:
    """Fills what readers take for granted."""
    return df.withColumn("face_type", F.coalesce("face_type", F.lit("full_face"))).withColumn(
        "eyebrows_expand_mod", F.coalesce("eyebrows_expand_mod", F.lit(1.0))
    )


def pack(spark: SparkSession, folder: str, target: str, persons: bool = False) -> DataFrame:
    """Writes a folder's pictures as one table (filename, content, person_name); with persons the
    folder of each file is its person."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(persons).lower()).load(folder)
    files = files.where(paths.is_image(F.col("path")))
    person = paths.parent_name(F.col("path")) if persons else F.lit(None).cast("string")
    files.select(paths.name(F.col("path")).alias("filename"), "content", person.alias("person_name")).write.parquet(target)
    return read(spark, target)


def read(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def unpack(packed: DataFrame, folder: str) -> int:
    """Writes each row's content as a file under a folder that all executors share; the number of files.

    A person's files go to a folder of the person's name. File names keep only their last part, so
    that no row can write outside. Rows that would be one file are an error before anything is written.
    """
    import os

    twice = packed.groupBy(F.regexp_extract("person_name", "[^/]*$", 0), F.regexp_extract("filename", "[^/]*$", 0)).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("several rows have one file name")

    def put(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content, person in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = os.path.join(folder, os.path.basename(person)) if person else folder
                os.makedirs(place, exist_ok=True)
                whole = os.path.join(place, os.path.basename(name))
                with open(f"{whole}.part", "wb") as file:
                    file.write(content)
                os.replace(f"{whole}.part", whole)  # a task that runs again leaves the same files
            yield pa.record_batch([pa.array([batch.num_rows])], names=["n"])

    done = packed.select("filename", "content", "person_name").mapInArrow(put, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load(spark: SparkSession, packed: str, folder: DataFrame) -> DataFrame:
    """The packed table if there is one, else what the folder's scan gave."""
    path = spark._jvm.org.apache.hadoop.fs.Path(packed)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return read(spark, packed) if there else folder


def save_metadata(faces: DataFrame, target: str) -> None:
    faces.drop("xseg_mask").write.parquet(target)


def restore_metadata(files: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with their saved metadata and whether to resize; and the files without any."""
    return restored(files, saved, "filename", "shape"), missing(files, saved, "filename", "filename")


def mask_source(df: DataFrame, mask: str = "xseg_mask", polygons: str = "seg_ie_polys") -> DataFrame:
    """Adds mask_source: 'mask' where there is one, 'polygons' where there are some; a row with
    neither is an error. Masks themselves are left out by their names."""
    kept = df.where(~F.contains(paths.stem(F.col("filename")), F.lit("_mask")))
    none = F.raise_error(F.concat(F.lit("neither mask nor polygons: "), F.col("filename")))
    source = F.when(F.col(mask).isNotNull(), "mask").when(F.coalesce(F.size(polygons), F.lit(0)) > 0, "polygons")
    return kept.withColumn("mask_source", source.otherwise(none.cast("string")))


def newest_versions(df: DataFrame, version: str, keep: int = 24) -> DataFrame:
    """The rows of the newest versions, as a rotating backup keeps them."""
    newest = df.agg((F.max(version) - keep).alias("_old"))
    return df.crossJoin(F.broadcast(newest)).where(F.col(version) > F.col("_old")).drop("_old")  # one row
