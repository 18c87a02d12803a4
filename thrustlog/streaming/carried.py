"""State carried from one micro-batch to the next as a table in the shared folder.

Every micro-batch N writes its state under ``batch=N`` and reads that of N-1, so a micro-batch that
runs again after a failure reads the same input and overwrites its own output.
"""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class CarriedTable:
    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def _folder(self, batch_id):
        return f"{self.path}/batch={batch_id}"

    def before(self, batch_id):
        """State after the previous micro-batch; empty in front of the first one."""
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(batch_id - 1))

    def save(self, rows, batch_id):
        names = [f.name for f in self.schema.fields]
        rows.select(*names).write.mode("overwrite").parquet(self._folder(batch_id))


def replaced(old, new, keys):
    """New rows, and the old ones of keys that have no new row; one row per key on both sides."""
    columns = old.columns
    both = new.select(*columns, F.lit(1).alias("_age")).unionByName(
        old.withColumn("_age", F.lit(0))
    )
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_age").alias("_row"))
    return latest.select("_row.*")


class BatchOutput:
    """Output rows of a stream, one folder per micro-batch."""

    def __init__(self, path):
        self.path = path

    def save(self, rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def of(self, spark, batch_id, schema):
        return spark.read.schema(schema).parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark, schema):
        """Rows of all micro-batches."""
        return self.numbered(spark, schema).drop("batch")

    def numbered(self, spark, schema):
        """Rows of all micro-batches with the number of theirs in ``batch``."""
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(self.path)


def run_stream(stream, handle, checkpoint, **trigger):
    """Start ``foreachBatch`` with its own checkpoint; ``availableNow=True`` drains the input."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )

