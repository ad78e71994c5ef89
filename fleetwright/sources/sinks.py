"""Writing property files and plan documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetwright.session import stored

# Records per output file of the "lines" layout.
FILE_RECORDS = 1_000_000
# Bytes of text that a container holds, about.
CONTAINER_BYTES = 64 << 20


def write_conf_texts(texts: DataFrame, path: str, layout: str = "lines",
                     mode: str = "errorifexists") -> None:
    """Store property files given as rows (file_name, pos, line).

    `lines` writes one JSON record per line, as the tasks come, without a shuffle and with
    as many owners as there are; names and keys repeat in all of them, so the files are compressed
    (`gzip`), each small enough to be read by one task. `files` writes one text file per owner into a folder
    named after it, its lines in order, and suits small selections, e.g. one cluster's jobs.
    """
    rows = texts.select("file_name", "pos", "line")
    if layout == "lines":
        rows.write.option("maxRecordsPerFile", FILE_RECORDS).mode(mode).json(path, compression="gzip")
    elif layout == "files":
        ordered = rows.repartition("file_name").sortWithinPartitions("file_name", "pos")
        ordered.select("file_name", "line").write.partitionBy("file_name").mode(mode).text(path)
    else:
        raise ValueError("layout is 'lines' or 'files'")


def read_conf_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file_name string, pos int, line string").json(path)


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Plan documents as JSON lines, one entry per line."""
    docs.write.mode(mode).json(path)


def write_containers(texts: DataFrame, path: str, container_bytes: int = CONTAINER_BYTES) -> None:
    """Property files given as rows (file_name, pos, line), many in one container file, with an index.

    Files are dealt to containers by their name, as many as the texts fill, and lie there one after another; the
    index has for each file its container, where it begins and how many bytes it has. The index is written last, so
    that a write which fails leaves nothing that `read_index` would find. A file stays whole: it must fit a task.
    """
    rows = stored(texts.select("file_name", "pos", "line", (F.octet_length("line") + 1).alias("bytes")), "texts")
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    containers = max(1, -(-size // container_bytes))
    dealt = rows.withColumn("container", F.pmod(F.xxhash64("file_name"), F.lit(containers)))
    order = ("container", "file_name", "pos", "line")
    lines = dealt.repartition(containers, "container").sortWithinPartitions(*order)
    lines.select("container", "line").write.partitionBy("container").mode("errorifexists").text(f"{path}/texts")
    sizes = dealt.groupBy("container", "file_name").agg(F.sum("bytes").alias("length"))
    before = Window.partitionBy("container").orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)
    index = sizes.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    index.select("file_name", "container", "offset", "length").write.mode("errorifexists").parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, container, offset, length) of all files of a finished write."""
    return spark.read.schema("file_name string, container long, offset long, length long").parquet(f"{path}/index")


def _cut_out(found: pa.Table, held: pa.Table) -> pa.Table:
    """The files of one container, cut out of its bytes."""
    names, starts, lengths = (found[c].to_pylist() for c in ("file_name", "offset", "length"))
    content = held["content"][0].as_buffer() if held.num_rows else None
    if content is None:
        names, starts, lengths = [], [], []
    texts = [content.slice(start, length).to_pybytes().decode("utf-8", "replace") for start, length in zip(starts, lengths, strict=True)]
    return pa.table([names, texts, lengths], schema=pa.schema([("file_name", pa.string()), ("text", pa.string()), ("length", pa.int64())]))


def look_up(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(file_name, text, length) of the named files; only their containers are read. Unknown names give no row.

    The bytes of a container move once, to the names found in it, however many these are.
    """
    found = read_index(spark, path).join(names.select("file_name").distinct(), "file_name")
    held = spark.read.format("binaryFile").load(f"{path}/texts").select(
        F.col("container").cast("long").alias("container"), "content")
    wanted = held.join(found.select("container").distinct(), "container", "left_semi")
    return found.groupBy("container").cogroup(wanted.groupBy("container")).applyInArrow(
        _cut_out, "file_name string, text string, length long")
