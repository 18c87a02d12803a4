"""CSV logs, processed traces and run reports."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from thrustlog.plans.per_run import run_keys
from thrustlog.schemas import wide_log
from thrustlog.sources import run_folders

CONVERTED = "converted_data.csv"
RAW = "raw_data.csv"
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def _listing(spark):
    """While folders are listed: eight tasks per core at most, as a task for each of many small folders costs more than its listing."""
    given = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, min(int(given), 8 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, given)


def read_log(spark, base, sensor_names, file_name=CONVERTED, armed=False):
    """Logs of all runs below ``base``: one folder per run, its name is the run's label.

    Folders written by ``append_log`` are named ``run_id=label``; their files go by ``*.csv``. With ``armed``
    the folders ``arm_no=N`` in them give ``arm_no``.
    """
    found = run_folders.read_by_label(spark, base, wide_log(sensor_names), file_name)
    if found is not None:
        return found.withColumn("arm_no", F.col("arm_no").try_cast("long")) if armed else found.drop("arm_no")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    label = F.regexp_extract(path, r"(?:run_id=)?([^/]+)(?:/arm_no=(\d+))?/[^/]+$", 1)
    with _listing(spark):
        log = (
            spark.read.schema(wide_log(sensor_names))
            .option("header", True)
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", file_name)
            .csv(base)
        )
    arm = {"arm_no": F.regexp_extract(path, r"/arm_no=(\d+)/[^/]+$", 1).try_cast("long")} if armed else {}
    return log.withColumns({"run_id": label, **arm})


def read_raw_log(spark, base, sensor_names, file_name=RAW, armed=False):
    return read_log(spark, base, sensor_names, file_name, armed)


FILE_SECONDS = 3600


def _per_run_files(wide, file_seconds):
    """Bring a run's rows together, an hour of it per file, so no task writes to every run."""
    stretch = F.floor(F.col("seconds") / F.lit(file_seconds))
    return wide.repartition(*run_keys(wide), stretch)


def _write(wide, path, mode, file_seconds):
    rows, keys = _per_run_files(wide, file_seconds), run_keys(wide)
    folder = run_folders.local_path(wide.sparkSession, path)
    if folder:
        run_folders.write(rows, keys, folder, replace=mode == "overwrite")
    else:
        rows.write.mode(mode).partitionBy(*keys).option("header", True).csv(path)


def append_log(wide, path, file_seconds=FILE_SECONDS):
    """Append wide readings, one folder per run, and in it one per arming where they have ``arm_no``; every file has its header."""
    _write(wide, path, "append", file_seconds)


def write_processed(wide, path, file_seconds=FILE_SECONDS):
    """Replace the processed traces."""
    _write(wide, path, "overwrite", file_seconds)


def read_partitioned_log(spark, path, sensor_names):
    """Read back what ``append_log`` or ``write_processed`` wrote."""
    found = run_folders.read_by_key(spark, path, wide_log(sensor_names))
    if found is not None:
        return found
    schema = wide_log(sensor_names).add("run_id", "string")
    with _listing(spark):
        return spark.read.schema(schema).option("header", True).csv(path)


def write_reports(texts, path):
    """Report text per run (``run_id, value``) or arming (``arm_no``), one folder for each."""
    texts.write.mode("overwrite").partitionBy(*run_keys(texts)).text(path)


def read_reports(spark, path):
    """Reports that ``write_reports`` wrote, one row per run."""
    with _listing(spark):
        rows = spark.read.schema("value string, run_id string").text(path, wholetext=True)
    return rows.select(*run_keys(rows), F.regexp_replace("value", r"\n\z", "").alias("value"))


def melt(wide, sensor_names):
    """Wide log to long form."""
    return wide.unpivot(
        [*run_keys(wide), "seconds"], list(sensor_names), "sensor_name", "value"
    )
