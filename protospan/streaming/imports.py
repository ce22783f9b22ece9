"""Incremental import of reports as a stream of files, each once by the hash of its content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from protospan.sources.report import quant, report_rows


def watch_reports(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends protein, run, intensity of every report that arrives in ``folder``; a file whose content was imported is skipped.

    The file source tells new files; the table, which has one folder per hash, tells copies under other names. An import
    that failed half way is no folder yet or is written over when its batch is repeated, so nothing is added twice.
    """
    layout = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.schema(layout).format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)

    def batch(df: DataFrame, number: int) -> None:
        files = df.select("path", F.sha2("content", 256).alias("hash")).groupBy("hash").agg(F.min("path").alias("path"))
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(table).getFileSystem(spark._jsc.hadoopConfiguration())
        for r in files.orderBy("path").collect():  # one row per file of this batch
            folder = f"{table}/hash={r.hash}"
            if not fs.exists(path(f"{folder}/_SUCCESS")):  # written last
                quant(report_rows(spark.read.parquet(r.path))).write.mode("overwrite").parquet(folder)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
