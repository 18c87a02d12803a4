"""Raw batches as a stream: gates, time axis over batches, conversion, append."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from thrustlog.operators import gates
from thrustlog.operators.convert import convert
from thrustlog.operators.decode import readings, until_run_time
from thrustlog.schemas import RAW_BATCH
from thrustlog.session import stored_table
from thrustlog.streaming.carried import replaced, run_stream

RUN_STATE = (
    "run_id string, past_transfers long, past_scans long, past_overruns long, past_armed int, past_arm_no long, seen timestamp"
)
RETENTION_SEC = 7 * 86_400
QUEUE_DEPTH = 50


def raw_batch_stream(spark, path, files_per_trigger=QUEUE_DEPTH, schema=RAW_BATCH):
    """Bounded intake: at most ``files_per_trigger`` files per micro-batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def entering(batches, before, nchan):
    """Batches in blocks, and the pieces of the micro-batch composed behind the runs' state ``before`` it."""
    rows = gates.in_blocks(batches, nchan)
    touched = before.join(batches.select("run_id").distinct(), "run_id", "left_semi")
    return rows, gates.composed(gates.pieces(rows).unionByName(gates.carried_pieces(touched)))


def accept_more(batches, before, nchan, frequency, max_seconds=0):
    """Accepted, numbered batches of one micro-batch, given the runs' state ``before`` it."""
    rows, found = entering(batches, before, nchan)
    return numbered(rows, found, frequency, max_seconds)


def numbered(rows, found, frequency, max_seconds=0):
    # a run goes on in the next micro-batch, so its length is not known
    return until_run_time(gates.accepted(rows, found).drop("run_scans"), frequency, max_seconds)


def state_after(batches, before, nchan, now=None, retention_sec=RETENTION_SEC):
    """State of every run after the micro-batch; with ``now``, without runs idle for ``retention_sec``."""
    return state_of(entering(batches, before, nchan)[1], before, now, retention_sec)


def state_of(found, before, now=None, retention_sec=RETENTION_SEC):
    new = gates.last_state(found).withColumn("seen", F.lit(now).cast("timestamp"))
    state = replaced(before, new, ["run_id"])
    if now is None:
        return state
    return state.where(F.col("seen") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(retention_sec)))


def ingest(
    stream, config, nchan, frequency, carried, output, checkpoint, max_seconds=0, retention_sec=RETENTION_SEC, **trigger
):
    """Decode, gate, convert and append every micro-batch.

    A run without batches for ``retention_sec`` of processing time leaves the state.
    ``carried`` is a ``CarriedTable`` with ``RUN_STATE``; ``output`` gets long converted readings.
    """

    def handle(batch, batch_id):
        before = carried.before(batch_id)
        rows, found = entering(batch, before, nchan)
        found = stored_table(found, "ingest-pieces")  # a few rows per block: output and state share one pass
        accepted = numbered(rows, found, frequency, max_seconds)
        output.save(convert(readings(accepted, nchan, frequency), config), batch_id)
        now = datetime.now(timezone.utc)
        carried.save(state_of(found, before, now, retention_sec), batch_id)

    return run_stream(stream, handle, checkpoint, **trigger)
