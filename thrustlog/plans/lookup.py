"""Join rows to a lookup table such as a sensor configuration.

The join is a plain one: Spark broadcasts the table by its size, at planning or at run time, and
splits skewed keys of a larger one, so building the plan runs no job.
"""

from pyspark.sql import functions as F


def lookup_join(rows, table, keys, on_unknown="fail"):
    """Rows with the columns of ``table``, which has one row per key.

    A key without an entry fails the query, or, with ``on_unknown`` "null", leaves the columns null,
    or, with "drop", leaves the row out. No row is lost silently.
    """
    if on_unknown == "drop":
        return rows.join(table, list(keys))
    marked = rows.join(table.withColumn("_known", F.lit(True)), list(keys), "left")
    if on_unknown == "null":
        return marked.drop("_known")
    key = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    refuse = F.raise_error(F.concat(F.lit(f"no entry for {', '.join(keys)}: "), key)).cast("boolean")
    return marked.where(F.coalesce(F.col("_known"), refuse)).drop("_known")
