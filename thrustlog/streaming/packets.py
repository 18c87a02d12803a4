"""Packets as they arrive: damaged lines set aside, commands to the state machine, messages to their acknowledgements."""

from pyspark.sql import functions as F

from thrustlog.constants import COMMAND_ACK_TIMEOUT_SEC
from thrustlog.operators.acks import after, match_acks
from thrustlog.operators.messages import acknowledgements, known_commands, parse_messages, text_messages
from thrustlog.session import stored_table
from thrustlog.sources.packets import DAMAGED
from thrustlog.streaming.carried import replaced, run_stream
from thrustlog.streaming.control import continue_timeline, last_states

WAITING = "id long, ts timestamp"


def commands_in(packets):
    """Known commands with a stand's address; those for no stand move no state machine."""
    parsed = known_commands(parse_messages(text_messages(packets)))
    return parsed.where(F.col("remoteid").isNotNull()).select("remoteid", "ts", "id", "command")


def continue_waiting(packets, waiting, timeout_sec=COMMAND_ACK_TIMEOUT_SEC):
    """All waiting and new messages with the first acknowledgement the packets hold for them, or null.

    A message without one is ``over`` once a packet after its timeout has come; else it goes on waiting.
    """
    messages = waiting.unionByName(text_messages(packets).select("id", "ts"))
    now = F.lit(packets.agg(F.max("ts")).first()[0]).cast("timestamp")
    over = F.col("ack_ts").isNotNull() | F.coalesce(after(F.col("ts"), timeout_sec) < now, F.lit(False))
    return match_acks(messages, acknowledgements(packets), timeout_sec).withColumn("over", over)


def receive(
    stream, stands, waiting, timeline, answers, damaged, checkpoint, timeout_sec=COMMAND_ACK_TIMEOUT_SEC, **trigger
):
    """Feed ``timeline``, ``answers`` and ``damaged`` from one packet stream and one checkpoint.

    Micro-batches come in time order; a micro-batch that runs again overwrites what it wrote. Each reads its
    packets once. ``timeline`` gets the state and relays after every command, ``answers`` each message once, with
    ``ack_ts``, or null when its timeout has passed, ``damaged`` the lines that are no packets. ``stands`` is a
    ``CarriedTable`` with ``STAND_STATE``, ``waiting`` one with ``WAITING``.
    """

    def handle(batch, batch_id):
        rows = stored_table(batch, "packets")
        damaged.save(rows.where(F.col(DAMAGED).isNotNull()).select(DAMAGED), batch_id)
        packets = rows.where(F.col(DAMAGED).isNull())
        before = stands.before(batch_id)
        states = continue_timeline(commands_in(packets), before)
        timeline.save(states, batch_id)
        saved = timeline.of(batch.sparkSession, batch_id, states.schema)
        stands.save(replaced(before, last_states(saved), ["remoteid"]), batch_id)
        messages = stored_table(continue_waiting(packets, waiting.before(batch_id), timeout_sec), "messages")
        answers.save(messages.where("over").drop("over"), batch_id)
        waiting.save(messages.where("NOT over"), batch_id)

    return run_stream(stream, handle, checkpoint, **trigger)
