"""Sent commands, their acknowledgements, and resends.

``sent`` has ``id, ts`` and request columns; ``acks`` has ``request_id, ts``.
"""

from pyspark.sql import functions as F

from thrustlog.constants import COMMAND_ACK_TIMEOUT_SEC
from thrustlog.operators.sessions import value_as_of
from thrustlog.plans.scan import next_value, previous_value, running, running_sum, time_block

BLOCK_SECONDS = 600
REQUEST = ("remoteid", "command", "request")
WATCHED = ("ready", "launch", "post-launch")  # a request of these ends when the ready switch is off


def after(ts, seconds):
    return ts + F.make_dt_interval(secs=F.lit(seconds))


def match_acks(sent, acks, timeout_sec=COMMAND_ACK_TIMEOUT_SEC, block_seconds=BLOCK_SECONDS):
    """Add ``ack_ts``, the first acknowledgement within the timeout, or null.

    Without a timeout (None) the first acknowledgement counts whenever it comes.
    Sent rows and acknowledgements of an id are laid on one time line and the next acknowledgement
    is carried back, so repeated acknowledgements of one id make no pairs.
    """
    columns = sent.columns
    nothing = [F.lit(None).cast(sent.schema[c].dataType).alias(c) for c in columns
               if c not in ("id", "ts")]
    no_ack = F.lit(None).cast("timestamp").alias("_ack")
    mine = sent.select(*columns, F.lit(0).alias("_rank"), no_ack)
    theirs = acks.select(
        F.col("request_id").alias("id"), "ts", *nothing,
        F.lit(1).alias("_rank"), F.col("ts").alias("_ack"),
    )
    carried = running(
        mine.unionByName(theirs),
        ["id"],
        ["ts", "_rank"],
        time_block(F.col("ts"), block_seconds),
        _next=next_value(F.col("_ack")),
    )
    answer = F.col("_next")
    if timeout_sec is not None:
        answer = F.when(answer <= after(F.col("ts"), timeout_sec), answer)
    return carried.where(F.col("_rank") == 0).select(*columns, answer.alias("ack_ts"))


def unacknowledged(matched):
    return matched.where(F.col("ack_ts").isNull()).drop("ack_ts")


def acknowledged_ids(acks):
    """The set of acknowledged ids as rows, one per id."""
    return acks.where(F.col("request_id").isNotNull()).select("request_id").distinct()


def answered(sent, acks, block_seconds=BLOCK_SECONDS):
    """Attempts with their first acknowledgement, however late; ids once acknowledged stay so."""
    return match_acks(sent, acks, None, block_seconds)


def request_outcome(answers, keys=REQUEST, timeout_sec=COMMAND_ACK_TIMEOUT_SEC):
    """A request is done by the first acknowledgement of any attempt, up to the last attempt's timeout.

    ``answers`` comes from ``answered``.
    """
    requests = answers.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.max("ts").alias("last_ts"), F.min("ack_ts").alias("_first")
    )
    done = F.coalesce(F.col("_first") <= after(F.col("last_ts"), timeout_sec), F.lit(False))
    return requests.select(
        *keys, "attempts", "last_ts", done.alias("done"), F.when(done, F.col("_first")).alias("done_ts")
    )


def attempts(sent, keys, block_seconds=BLOCK_SECONDS):
    """Number of each attempt within its request and seconds since the one before."""
    numbered = running(
        sent,
        list(keys),
        ("ts", "id"),
        time_block(F.col("ts"), block_seconds),
        attempt=running_sum(F.lit(1).cast("long")),
        _before=previous_value(F.unix_micros("ts")),
    )
    gap = (F.unix_micros("ts") - F.col("_before")) / F.lit(1e6)
    return numbered.withColumn("gap_sec", gap).drop("_before")


def aborted_requests(answers, ready_changes, keys=REQUEST, timeout_sec=COMMAND_ACK_TIMEOUT_SEC, attempts_of=None):
    """Requests that end in safe: at the first timeout without an acknowledgement and with the ready switch off.

    One row per request. Requests to be safe go on whatever the switch says. ``ready_changes`` has
    ``remoteid, ts, id, ready``; a switch never seen counts as off. Only timeouts of the attempts in ``attempts_of`` count,
    if it is given: a condition on ``answers``.
    """
    first = answers.groupBy(*keys).agg(F.min("ack_ts").alias("_first"))
    asked = answers if attempts_of is None else answers.where(attempts_of)
    watched = asked.where(F.col("command").isin(*WATCHED)).drop("ack_ts").join(first, list(keys))
    waited = watched.withColumn("sent_ts", F.col("ts")).withColumn("ts", after(F.col("ts"), timeout_sec))
    failed = waited.where(F.coalesce(F.col("_first") > F.col("ts"), F.lit(True))).drop("_first")
    seen = value_as_of(failed, ready_changes, "ready")
    off = seen.where(~F.coalesce(F.col("ready"), F.lit(False)))
    return (
        off.groupBy(*keys)
        .agg(F.min(F.struct(F.col("ts").alias("abort_ts"), "id", "sent_ts")).alias("_row"))
        .select(*keys, "_row.*", F.lit("safe").alias("ends_in"))
    )


def wait_aborts(log, block_seconds=BLOCK_SECONDS):
    """Rows at which the ready switch is off while a ready stand waits for the launch switch.

    ``log`` has ``remoteid, ts, id, ready, launch`` and ``waits``: whether the stand was in state
    ready before the row. Only the row at which ready goes off counts.
    """
    waiting = F.col("waits") & ~F.col("launch")
    before = running(
        log, ["remoteid"], ("ts", "id"), time_block(F.col("ts"), block_seconds), _ready=previous_value(F.col("ready")),
    )
    return before.where(waiting & ~F.col("ready") & F.coalesce(F.col("_ready"), F.lit(True))).select(
        "remoteid", "ts", "id", F.lit("safe").alias("ends_in")
    )


def hold_aborts(switches, block_seconds=BLOCK_SECONDS):
    """Rows at which the ready switch goes off while launch is held on: the launch ends in safe.

    ``switches`` have ``remoteid, ts, id, ready, launch``.
    """
    held = F.col("ready") & F.col("launch")
    before = running(
        switches,
        ["remoteid"],
        ("ts", "id"),
        time_block(F.col("ts"), block_seconds),
        _held=previous_value(held),
    )
    dropped = F.col("launch") & ~F.col("ready") & F.coalesce(F.col("_held"), F.lit(False))
    return before.where(dropped).select("remoteid", "ts", "id", F.lit("safe").alias("ends_in"))


def open_attempts(answers, keys=REQUEST, timeout_sec=COMMAND_ACK_TIMEOUT_SEC, aborted=None):
    """Attempts of requests that are neither done nor, if these are given, aborted."""
    outcome = request_outcome(answers, keys, timeout_sec)
    waiting = answers.join(outcome.where(~F.col("done")).select(*keys), list(keys), "left_semi")
    if aborted is None:
        return waiting
    return waiting.join(aborted.select(*keys), list(keys), "left_anti")


def due_resends(waiting, now, timeout_sec=COMMAND_ACK_TIMEOUT_SEC, keys=REQUEST):
    """Requests whose last attempt is at least the timeout ago; ``waiting`` as from ``open_attempts``."""
    requests = waiting.groupBy(*keys).agg(
        F.count("*").alias("attempts"), F.max("ts").alias("last_ts")
    )
    return requests.where(after(F.col("last_ts"), timeout_sec) <= now)
