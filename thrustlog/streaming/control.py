"""The command log as a stream: states, relays, routing, finished runs, resends."""

from pyspark.sql import functions as F

from thrustlog.constants import COMMAND_ACK_TIMEOUT_SEC, RELAYS
from thrustlog.operators.acks import REQUEST, aborted_requests, after, answered, due_resends, open_attempts
from thrustlog.operators.sessions import sessions
from thrustlog.operators.timeline import full_timeline
from thrustlog.session import stored_table
from thrustlog.streaming.carried import replaced, run_stream

STAND_STATE = (
    "remoteid long, ts timestamp, id long, state string, "
    + ", ".join(f"{r} boolean" for r in RELAYS)
)
OPEN_SESSION = "remoteid long, ts timestamp, id long"
OPEN_ATTEMPT = (
    "remoteid long, command string, request string, id long, ts timestamp, ack_ts timestamp, judged boolean, abort_ts timestamp"
)
SWITCH_STATE = "remoteid long, ts timestamp, id long, ready boolean"
RETENTION_SEC = 2 * 86_400


def continue_timeline(commands, before):
    """State and relay timeline of one micro-batch from the stands' state ``before`` it.

    That state is laid in front of the stand's commands as a seed row, so the batch operators run
    unchanged. Rows of a micro-batch are taken in time order; an earlier micro-batch comes first,
    whatever its times.
    """
    first = commands.groupBy("remoteid").agg(F.min("ts").alias("_first"))
    seeds = before.join(first, "remoteid").select(
        "remoteid",
        (F.col("_first") - F.expr("INTERVAL 1 MICROSECOND")).alias("ts"),
        "id",
        F.lit(None).cast("string").alias("command"),
        F.col("state").alias("seed_state"),
        *[F.col(r).alias(f"seed_{r}") for r in RELAYS],
    )
    rows = commands.select("remoteid", "ts", "id", "command")
    seeded = rows.unionByName(seeds, allowMissingColumns=True)
    timeline = full_timeline(seeded)
    return timeline.where(F.col("seed_state").isNull()).select(
        "remoteid", "ts", "id", "command", "state_before", "state", *RELAYS
    )


def last_states(timeline):
    """The stands' state after a timeline."""
    kept = ["ts", "id", "state", *RELAYS]
    return (
        timeline.groupBy("remoteid")
        .agg(F.max_by(F.struct(*kept), F.struct("ts", "id")).alias("_last"))
        .select("remoteid", "_last.*")
    )


def run_state_machine(stream, carried, output, checkpoint, **trigger):
    """Timeline of all stands; ``carried`` is a ``CarriedTable`` with ``STAND_STATE``."""

    def handle(batch, batch_id):
        before = carried.before(batch_id)
        timeline = continue_timeline(batch, before)
        output.save(timeline, batch_id)
        saved = output.of(batch.sparkSession, batch_id, timeline.schema)
        carried.save(replaced(before, last_states(saved), ["remoteid"]), batch_id)

    return run_stream(stream, handle, checkpoint, **trigger)


def route_commands(stream, folder, checkpoint, **trigger):
    """Commands handed over by name: each micro-batch is written once, a folder per command."""

    def handle(batch, batch_id):
        target = f"{folder}/batch={batch_id}"
        batch.withColumn("route", F.col("command")).write.mode("overwrite").partitionBy("route").parquet(target)

    return run_stream(stream, handle, checkpoint, **trigger)


def routed(spark, folder, schema, command):
    """The commands of one name that ``route_commands`` has handed over."""
    rows = spark.read.schema(f"{schema}, batch long, route string").parquet(folder)
    return rows.where(F.col("route") == command).drop("batch", "route")


def continue_sessions(commands, open_before):
    """Sessions touched by one micro-batch: an open one goes in as its opening command."""
    opened = open_before.select("remoteid", "ts", "id", F.lit("ready").alias("command"))
    return sessions(opened.unionByName(commands.select("remoteid", "ts", "id", "command")))


def finish_runs(stream, analyse, carried, closed, output, checkpoint, **trigger):
    """Analyse each run when its session closes.

    ``closed`` gets the sessions that closed (``remoteid, start_ts, start_id, end_ts, end_id``);
    ``analyse`` maps them to the rows for ``output``, as a rule the run summaries of the readings
    they cover.
    """

    def handle(batch, batch_id):
        table = continue_sessions(batch, carried.before(batch_id))
        still_open = table.where(F.col("end_ts").isNull()).select(
            "remoteid", F.col("start_ts").alias("ts"), F.col("start_id").alias("id")
        )
        closed.save(table.where(F.col("end_ts").isNotNull()), batch_id)
        output.save(analyse(closed.of(batch.sparkSession, batch_id, table.schema)), batch_id)
        carried.save(still_open, batch_id)

    return run_stream(stream, handle, checkpoint, **trigger)


def continue_requests(sent, acks, before):
    """All carried and new attempts with the first acknowledgement seen so far; new ones of aborted requests are left out."""
    nothing = F.lit(None).cast("timestamp")
    ended = before.where(F.col("abort_ts").isNotNull()).select(*REQUEST).distinct()
    known = before.where(F.col("abort_ts").isNull()).withColumnRenamed("ack_ts", "_known")
    new = sent.join(ended, list(REQUEST), "left_anti").withColumns(
        {"_known": nothing, "judged": F.lit(False), "abort_ts": nothing}
    )
    found = answered(known.unionByName(new.select(*known.columns)), acks)
    return found.withColumn("ack_ts", F.least("_known", "ack_ts")).select(*before.columns)


def judge_timeouts(attempts, switches, now, timeout_sec=COMMAND_ACK_TIMEOUT_SEC):
    """Attempts after all timeouts up to ``now`` are judged once, by the switch position in force at each.

    Of a request that ends in safe one row is left, that of the attempt whose timeout ended it, with ``abort_ts``.
    ``switches`` has the positions known before the micro-batch and those it brings.
    """
    over = after(F.col("ts"), timeout_sec) <= now
    ended = aborted_requests(attempts, switches, REQUEST, timeout_sec, over & ~F.col("judged")).select(
        *REQUEST, F.col("id").alias("_ending"), F.col("abort_ts").alias("_abort")
    )
    met = attempts.join(ended, list(REQUEST), "left").where(F.col("_abort").isNull() | (F.col("id") == F.col("_ending")))
    return met.withColumns({"judged": F.col("judged") | over, "abort_ts": F.col("_abort")}).select(*attempts.columns)


def kept_requests(attempts, now, retention_sec=RETENTION_SEC):
    """Attempts to carry on: those of requests whose last attempt, or abort, is within the retention time.

    So done, aborted and unanswered requests leave alike, and a late attempt does not open a request again before.
    """
    last = attempts.groupBy(*REQUEST).agg(F.max(F.coalesce("abort_ts", "ts")).alias("_last"))
    over = last.where(after(F.col("_last"), retention_sec) < now)
    return attempts.join(over.select(*REQUEST), list(REQUEST), "left_anti")


def last_switches(switches):
    """The position of each stand's ready switch after the rows."""
    last = F.max_by(F.struct("ts", "id", "ready"), F.struct("ts", "id")).alias("_last")
    return switches.groupBy("remoteid").agg(last).select("remoteid", "_last.*")


def decide_resends(
    stream, carried, positions, output, checkpoint, timeout_sec=COMMAND_ACK_TIMEOUT_SEC, retention_sec=RETENTION_SEC, **trigger
):
    """Requests to send again, by the latest time seen in each micro-batch.

    The stream has ``kind`` (``sent``, ``ack`` or ``switch``), the columns of a sent message, ``request_id`` of an
    acknowledgement and ``ready`` of a switch. Micro-batches come in time order. A request
    that is done, ended in safe, or has had no answer is carried for ``retention_sec`` after its last attempt or its end.
    ``carried`` is a ``CarriedTable`` with ``OPEN_ATTEMPT``, ``positions`` one with ``SWITCH_STATE``.
    """

    def handle(batch, batch_id):
        before = carried.before(batch_id)
        now = F.lit(batch.agg(F.max("ts")).first()[0]).cast("timestamp")
        moved = batch.where(F.col("kind") == "switch").select("remoteid", "ts", "id", "ready")
        switches = positions.before(batch_id).unionByName(moved)
        attempts = continue_requests(
            batch.where(F.col("kind") == "sent"), batch.where(F.col("kind") == "ack").select("request_id", "ts"), before
        )
        attempts = stored_table(attempts, "attempts")  # outcomes, aborts and state read it
        ended = before.where(F.col("abort_ts").isNotNull())
        judged = judge_timeouts(attempts, switches, now, timeout_sec).unionByName(ended)
        carried.save(kept_requests(judged, now, retention_sec), batch_id)
        positions.save(last_switches(switches), batch_id)
        live = carried.before(batch_id + 1).where(F.col("abort_ts").isNull())
        output.save(due_resends(open_attempts(live, REQUEST, timeout_sec), now, timeout_sec), batch_id)

    return run_stream(stream, handle, checkpoint, **trigger)
