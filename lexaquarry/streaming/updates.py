"""An index that follows a stream of records: each micro-batch is one update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..plans.build import BuildOptions, update
from ..sources import files


def follow(stream: DataFrame, path: str, options: BuildOptions, checkpoint: str, deleted: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Applies a stream of records to the index at ``path``; rows with the boolean column ``deleted`` set are removals. Of
    several rows of one ref in a batch the last by column ``seq`` counts (any, without one). A batch that is delivered
    again after a failure changes nothing: the index remembers the last batch that it took."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = f"{path}/STREAM"
        if files.exists(spark, mark) and int(files.read(spark, mark)) >= number:
            return
        order = Window.partitionBy("ref").orderBy(F.desc("seq") if "seq" in batch.columns else F.lit(1))
        rows = batch.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n", "seq")
        gone = rows.filter(F.coalesce(F.col(deleted), F.lit(False))).select("ref") if deleted else None
        new = rows.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else rows
        update(spark, path, new, gone, options)
        files.replace(spark, mark, str(number))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
