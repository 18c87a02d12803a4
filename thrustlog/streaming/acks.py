"""Acknowledgement matching as a stream-stream join."""

from pyspark.sql import functions as F

from thrustlog.constants import COMMAND_ACK_TIMEOUT_SEC


def match_ack_streams(sent, acks, timeout_sec=COMMAND_ACK_TIMEOUT_SEC, lateness="10 minutes"):
    """Sent messages with the first acknowledgement inside the timeout, or with null when none came.

    Both sides carry a watermark, so state is dropped once no partner can come any more; a message
    appears when the watermark has passed its timeout. ``sent`` has ``id, ts``, ``acks`` has
    ``request_id, ts``. Repeated acknowledgements meet in one minimum per message.
    """
    left = sent.withColumnRenamed("ts", "sent_ts").withWatermark("sent_ts", lateness)
    right = acks.select("request_id", F.col("ts").alias("ack_ts")).withWatermark("ack_ts", lateness)
    joined = left.join(
        right,
        (F.col("id") == F.col("request_id"))
        & (F.col("ack_ts") >= F.col("sent_ts"))
        & (F.col("ack_ts") <= F.col("sent_ts") + F.expr(f"INTERVAL {int(timeout_sec)} SECONDS")),
        "leftOuter",
    )
    return joined.groupBy(*left.columns).agg(F.min("ack_ts").alias("ack_ts"))
