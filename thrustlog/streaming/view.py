"""Live trailing view as a stream."""

from pyspark.sql import functions as F

from thrustlog.operators.view import latest_points
from thrustlog.plans.scan import number_block
from thrustlog.streaming.carried import run_stream

VIEW_STATE = "run_id string, sensor_name string, scan_no long, y double"
SCANS_PER_BLOCK = 4096


def continue_view(rows, before, size):
    """Latest ``size`` points per run and sensor after a micro-batch."""
    both = before.unionByName(rows.select(*before.columns))
    return latest_points(
        both,
        ["run_id", "sensor_name"],
        ["scan_no"],
        number_block(F.col("scan_no"), SCANS_PER_BLOCK),
        size,
    )


def live_view(stream, size, carried, output, checkpoint, **trigger):
    """Keep the view current; ``output`` gets the whole view after each micro-batch."""

    def handle(batch, batch_id):
        output.save(continue_view(batch, carried.before(batch_id), size), batch_id)
        carried.save(output.of(batch.sparkSession, batch_id, carried.schema), batch_id)

    return run_stream(stream, handle, checkpoint, **trigger)
