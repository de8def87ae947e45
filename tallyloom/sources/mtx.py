"""MatrixMarket coordinate files as edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.scratch import scratch_path

BANNER = "%%MatrixMarket"


def _opening(spark: SparkSession, path: str) -> tuple[list[str], str]:
    """The file that begins with the banner, as Spark may spell it, and the banner.

    Only first lines are read, by the driver, in the order of the names, until
    the banner is found; :func:`write_mtx` puts it into a part that sorts first.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    for name in sorted(spark.read.text(path).inputFiles()):
        file = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)).toString())
        stream, codec = file.getFileSystem(conf).open(file), codecs.getCodec(file)
        text = jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        reader = jvm.java.io.BufferedReader(text)
        line = reader.readLine()
        reader.close()
        if line is not None and line.startswith(BANNER):
            return [file.toString(), file.toUri().toString(), name], line
    raise ValueError(f"no {BANNER} line in {path}")


def _without_first_of_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All values but the first one marked as ``head``. A task reads a split in order, so that is the size line."""
    found = False
    for batch in batches:
        at = -1 if found else pc.index(batch.column("head"), True).as_py()
        values = batch.select(["value"])
        if at < 0:
            yield values
            continue
        found = True
        yield values.slice(0, at)
        yield values.slice(at + 1)


def read_mtx(spark: SparkSession, path: str, zero_based: bool = True) -> DataFrame:
    """Edges ``src, dst, weight`` of a MatrixMarket file (or a folder of its parts).

    The lines are scanned once. The size line is the first content line of the
    file with the banner, and is left out where it is met; entries equal to it
    stay. ``symmetric`` files also give the mirrored off-diagonal entries,
    ``pattern`` files get weight 1. A second file with a banner raises.
    """
    header, banner = _opening(spark, path)
    words = banner.lower().split()
    if len(words) < 5:
        raise ValueError(f"unsupported MatrixMarket header: {banner}")
    field, symmetry = words[3], words[4]
    if words[2] != "coordinate" or field not in ("pattern", "real", "integer"):
        raise ValueError(f"unsupported MatrixMarket header: {banner}")
    if symmetry not in ("general", "symmetric"):
        raise ValueError(f"unsupported MatrixMarket symmetry: {symmetry}")

    in_header = F.col("_metadata.file_path").isin(header)
    second = F.raise_error(F.concat(F.lit(f"a second {BANNER} line, in "), F.col("_metadata.file_path"))).cast("boolean")
    content = ~F.col("value").startswith("%") & (F.trim("value") != "")
    lines = (
        spark.read.text(path)
        .select("value", (in_header & (F.col("_metadata.file_block_start") == 0)).alias("head"),
                F.when(F.col("value").startswith(BANNER) & ~in_header, second).otherwise(content).alias("kept"))
        .where("kept").select("value", "head")
        .mapInArrow(_without_first_of_head, "value string")
    )
    part = F.split(F.trim("value"), r"\s+")
    shift = 1 if zero_based else 0

    def entry(index: int, kind: str) -> Column:
        return part.getItem(index).cast(kind)

    edges = lines.select(
        (entry(0, "bigint") - shift).alias("src"),
        (entry(1, "bigint") - shift).alias("dst"),
        (F.lit(1.0) if field == "pattern" else entry(2, "double")).alias("weight"),
    )
    if symmetry == "symmetric":
        edges = edges.select(
            F.explode(
                F.when(F.col("src") == F.col("dst"), F.array(F.struct("src", "dst", "weight"))).otherwise(
                    F.array(
                        F.struct("src", "dst", "weight"),
                        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"),
                    )
                )
            ).alias("e")
        ).select("e.*")
    return edges


def write_mtx(edges: DataFrame, path: str | None = None) -> str:
    """Store ``src, dst, weight`` (0-based) as a folder of MatrixMarket parts and return its path.

    The header is a part of its own, so the entries are written in parallel.
    """
    spark = edges.sparkSession
    path = path or scratch_path(spark, "mtx")
    shape = edges.agg(
        F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("n"), F.count("*").alias("nnz")
    ).first()
    header = [
        (f"{BANNER} matrix coordinate real general\n% stored by part\n{shape['n']} {shape['n']} {shape['nnz']}",)
    ]
    spark.createDataFrame(header, "value string").coalesce(1).write.text(path)
    edges.select(
        F.concat_ws(" ", (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string"), F.col("weight").cast("string")).alias("value")
    ).write.mode("append").text(path)
    return path
