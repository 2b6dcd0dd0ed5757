"""Files and tables that a plan writes on its way, in the folder that all executors see."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars_csv import RAW, file_of


def folder(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; in local mode, where none is named, under the system's temporary folder."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        shared = f"file://{tempfile.gettempdir()}/panelyx-shared"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/panelyx-{label}-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, path: str) -> str:
    """lines: (file, line). One text file for each name, its lines in no order; returns path.

    Spark names the files it writes; each is the only one of its name's partition and is renamed in place afterwards.
    """
    spark = lines.sparkSession
    lines.select("file", "line").repartition("file").write.partitionBy("file").text(f"{path}/parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/parts")
    fs = at.getFileSystem(conf)
    for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(at, "file=*/part-*")):  # one a name: a few symbols
        name = part.getPath().getParent().getName().removeprefix("file=")
        fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
    fs.delete(at, True)
    return path


def write_bar_files(rows: DataFrame, path: str, minutes: int, header: bool = False) -> str:
    """rows: ts, symbol, open .. trades. A bar file for each symbol ("S00" as "S00USD_60.csv"); returns path."""
    names = {f"{n}": F.coalesce(F.col(n).cast("string"), F.lit("")) for n in RAW[1:]}
    line = F.concat_ws(",", F.unix_seconds("ts").cast("string"), *names.values())
    lines = rows.select(F.concat("symbol", F.lit(file_of("/USD", minutes))).alias("file"), line.alias("line"))
    if header:
        lines = lines.unionByName(lines.select("file").distinct().withColumn("line", F.lit(",".join(RAW))))
    return write_lines(lines, path)
