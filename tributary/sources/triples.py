"""Reading and writing N-Triples text."""

from __future__ import annotations

import shutil
import sys
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import ntriples as nt
from tributary.session import shared_dir
from tributary.sources.bgz import BgzSource

#: Parts of files that have numbers of their own, about, and line numbers of one.
PARTS, PART_LINES = 1 << 28, 1 << 33


def _copied(path: str) -> str:
    """Standard input as a file."""
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0])
    with store.open_output_stream(place) as out:
        shutil.copyfileobj(sys.stdin.buffer, out, 1 << 20)
    return path


def read_lines(spark: SparkSession, path: str, block: bool = False) -> DataFrame:
    """line_no and line. Plain, .gz and .bz2 go through Spark's text reader, .bgz (a file, or a folder with block=True) by blocks.

    The path - is standard input, which is copied to the shared folder first.
    line_no orders the lines of one file; files are ordered by path, and their parts by where they begin. The driver gets a row a file.
    """
    if path == "-":
        path = _copied(f"{shared_dir(spark)}/stdin/{uuid.uuid4().hex}.nt")
    if block or path.endswith(".bgz"):
        spark.dataSource.register(BgzSource)
        return spark.read.format("bgz").load(path)
    lines = spark.read.text(path)
    line, row = F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id()
    files = sorted(spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size").distinct().collect())
    if len(files) <= 1:  # Spark reads the parts of one file in their order
        return lines.select(row.alias("line_no"), line)
    # Spark packs files into tasks by size: a part's number is of its file's place and where it begins
    step, begins, number = sum(f["file_size"] for f in files) // PARTS + 1, [], 0
    for f in files:
        begins.append((f["file_path"], number))
        number += f["file_size"] // step + 1
    own = lines.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), row.alias("__row"), line)
    places = spark.createDataFrame(begins, "__file string, __number long")
    part = F.col("__number") + F.expr(f"__start div {step}")
    return own.join(F.broadcast(places), "__file").select((part * PART_LINES + F.col("__row") % PART_LINES).alias("line_no"), "line")


def parse(lines: DataFrame) -> DataFrame:
    """line_no, s, p, o, line of each triple; comments, blank and over-long lines are left out."""
    tokens = nt.tokens(F.col("line"))
    return lines.where(nt.is_data(F.col("line"))).select("line_no", *(nt.nth(tokens, n).alias(c) for n, c in enumerate("spo")), "line")


def read_ntriples(spark: SparkSession, path: str, block: bool = False) -> DataFrame:
    return parse(read_lines(spark, path, block))


def write_lines(triples: DataFrame, path: str, compression: str = "gzip") -> None:
    """The triples' own lines, as text; compression 'bgz' writes blocks."""
    if compression == "bgz":
        triples.sparkSession.dataSource.register(BgzSource)
        triples.select("line").write.format("bgz").mode("overwrite").save(path)
        return
    triples.select("line").write.mode("overwrite").option("compression", compression).text(path)
