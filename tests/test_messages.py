"""Messages, acknowledgements and attempts on hand-made cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thrustlog.operators import acks, messages, sessions
from thrustlog.streaming import control

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("text, want", [
    ('{"remoteid": 5, "command": "ready"}', (5, "ready", None)),
    ('{"remoteid": 5.0, "command": "ready"}', (5, "ready", None)),
    ('{"remoteid": true, "command": "ready"}', (1, "ready", None)),
    ('{"remoteid": null, "command": "ready"}', (None, "ready", None)),
    ('{"remoteid": 5, "command": "ready", "args": {"a": [1]}}', (5, "ready", '{"a":[1]}')),
    ('{"remoteid": "5", "command": "ready"}', None),
    ('{"remoteid": 5.5, "command": "ready"}', None),
    ('{"command": "ready"}', None),
    ('{"remoteid": 5, "comm', None),
    ("[1, 2]", None),
    ("7", None),
    ("", None),
])
def test_parse(spark, text, want):
    df = spark.createDataFrame([(1, T0, text)], "id long, ts timestamp, text string")
    got = [(r.remoteid, r.command, r.args) for r in messages.parse_messages(df).collect()]
    assert got == ([want] if want else [])


def test_packet_may_be_both(spark):
    df = spark.createDataFrame(
        [(1, "ACK", ("hi", 9), T0), (2, None, ("hi", None), T0), (3, "ACK", (None, 8), T0), (4, None, None, T0)],
        "id long, priority string, decoded struct<text string, requestId long>, ts timestamp",
    )
    assert sorted(r.request_id for r in messages.acknowledgements(df).collect()) == [8, 9]
    assert sorted(r.id for r in messages.text_messages(df).collect()) == [1, 2]


def test_envelope(spark):
    df = spark.createDataFrame([(5, "ready", "x"), (None, "safe", "")], "r long, c string, a string")
    got = df.select(messages.command_envelope(F.col("r"), F.col("c"), F.col("a")).alias("t")).collect()
    assert [r.t for r in got] == [
        '{"remoteid":5,"command":"ready","args":"x"}', '{"remoteid":null,"command":"safe"}',
    ]


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_ack_window(spark):
    sent = spark.createDataFrame([(i, at(100), "r") for i in range(1, 7)], "id long, ts timestamp, request string")
    given = [(1, 100), (2, 160), (3, 161), (4, 99), (5, 150), (5, 120), (5, 500)]
    answers = spark.createDataFrame([(i, at(s)) for i, s in given], "request_id long, ts timestamp")
    got = {r.id: r.ack_ts for r in acks.match_acks(sent, answers, 60, block_seconds=7).collect()}
    assert got == {1: at(100), 2: at(160), 3: None, 4: None, 5: at(120), 6: None}


def test_many_acks_of_one_id_make_no_pairs(spark):
    sent = spark.createDataFrame([(1, at(0), "r")], "id long, ts timestamp, request string")
    answers = spark.range(5000).select(
        F.lit(1).cast("long").alias("request_id"),
        (F.lit(at(0)) + F.make_dt_interval(secs=F.col("id") / 100)).alias("ts"),
    )
    assert acks.match_acks(sent, answers, 60).collect()[0].ack_ts == at(0)


ATTEMPT = "remoteid long, command string, request string, id long, ts timestamp"


def test_attempts_and_outcome(spark):
    rows = [(7, "ready", "a", 1, at(0)), (7, "ready", "a", 2, at(60)), (7, "ready", "b", 3, at(200)), (7, "safe", "c", 4, at(0))]
    sent = spark.createDataFrame(rows, ATTEMPT)
    keys = ["remoteid", "command", "request"]
    got = acks.attempts(sent, keys).orderBy("id").collect()
    assert [(r.attempt, r.gap_sec) for r in got] == [(1, None), (2, 60.0), (1, None), (1, None)]
    # the first attempt's acknowledgement counts up to the last attempt's timeout
    answers = acks.answered(sent, spark.createDataFrame([(1, at(70)), (1, at(90)), (4, at(61))], "request_id long, ts timestamp"))
    outcome = {r.request: (r.done, r.done_ts) for r in acks.request_outcome(answers).collect()}
    assert outcome == {"a": (True, at(70)), "b": (False, None), "c": (False, None)}
    waiting = acks.open_attempts(answers)
    assert [r.request for r in acks.due_resends(waiting, F.lit(at(259))).collect()] == ["c"]
    assert sorted(r.request for r in acks.due_resends(waiting, F.lit(at(260))).collect()) == ["b", "c"]


def test_a_request_aborts_once_and_safe_never(spark):
    rows = [
        (7, "ready", "a", 1, at(0)), (7, "ready", "a", 2, at(60)), (7, "safe", "b", 3, at(0)), (8, "launch", "c", 4, at(0)),
        (9, "launch", "d", 5, at(0)), (9, "launch", "d", 6, at(60)), (9, "ready", "e", 7, at(0)),
    ]
    sent = spark.createDataFrame(rows, ATTEMPT)
    given = spark.createDataFrame([(7, at(59))], "request_id long, ts timestamp")
    changes = spark.createDataFrame(
        [(8, at(0), 1, True), (9, at(0), 2, True), (9, at(100), 3, False)], "remoteid long, ts timestamp, id long, ready boolean"
    )
    answers = acks.answered(sent, given)
    aborted = acks.aborted_requests(answers, changes)
    assert sorted((r.request, r.id, r.abort_ts) for r in aborted.collect()) == [("a", 1, at(60)), ("d", 6, at(120))]
    open_ = acks.open_attempts(answers, aborted=aborted)
    assert {r.request for r in open_.collect()} == {"b", "c"}


def test_done_and_unanswered_requests_are_carried_for_a_while(spark):
    rows = [(7, "ready", "a", 1, at(0), at(5), True, None), (7, "ready", "b", 2, at(0), None, True, None), (7, "ready", "d", 4, at(0), None, True, at(60))]
    before = spark.createDataFrame(rows, control.OPEN_ATTEMPT)
    late = spark.createDataFrame([(7, "ready", "a", 3, at(500)), (7, "ready", "d", 5, at(500))], ATTEMPT)
    none = spark.createDataFrame([], "request_id long, ts timestamp")
    attempts = control.continue_requests(late, none, before)
    assert {r.request for r in acks.open_attempts(attempts).collect()} == {"b"}
    judged = attempts.unionByName(before.where("abort_ts IS NOT NULL"))
    assert {r.id for r in control.kept_requests(judged, F.lit(at(600)), retention_sec=600).collect()} == {1, 2, 3, 4}
    assert {r.id for r in control.kept_requests(judged, F.lit(at(600)), retention_sec=200).collect()} == {1, 3}
    assert control.kept_requests(judged, F.lit(at(600)), retention_sec=50).count() == 0


@pytest.mark.parametrize("ends", [(55, 64, 130, 400), (130, 400), (400,)])
def test_resends_of_micro_batches(spark, ends):
    """One request ends in safe, one has a late answer, one has none, one is to be safe with the switch off."""
    sent = [
        (7, "ready", "ended", 1, at(0)), (7, "ready", "ended", 2, at(70)), (8, "launch", "late", 3, at(0)), (8, "launch", "late", 4, at(60)),
        (9, "ready", "never", 5, at(0)), (7, "safe", "safe", 6, at(10)), (5, "ready", "unseen", 7, at(0)),
    ]
    given = [(3, at(100)), (1, at(90))]
    moved = [(7, at(0), 20, True), (8, at(0), 21, True), (9, at(0), 22, True), (7, at(50), 23, False), (7, at(65), 24, True), (9, at(200), 25, False)]
    state, positions, low = spark.createDataFrame([], control.OPEN_ATTEMPT), spark.createDataFrame([], control.SWITCH_STATE), -1

    def part(rows, place, schema):
        return spark.createDataFrame([r for r in rows if at(low) < r[place] <= at(high)], schema)

    for high in ends:
        now = F.lit(at(high))
        switches = positions.unionByName(part(moved, 1, control.SWITCH_STATE))
        attempts = control.continue_requests(part(sent, 4, ATTEMPT), part(given, 1, "request_id long, ts timestamp"), state)
        ended = state.where("abort_ts IS NOT NULL")
        kept = control.kept_requests(control.judge_timeouts(attempts, switches, now).unionByName(ended), now, 1000)
        state = spark.createDataFrame(kept.collect(), control.OPEN_ATTEMPT)
        positions = spark.createDataFrame(control.last_switches(switches).collect(), control.SWITCH_STATE)
        low = high
    over = {(r.request, r.id, r.abort_ts) for r in state.where("abort_ts IS NOT NULL").collect()}
    assert over == {("ended", 1, at(60)), ("unseen", 7, at(60))}
    waiting = acks.open_attempts(state.where("abort_ts IS NULL"))
    assert {r.request for r in acks.due_resends(waiting, F.lit(at(400))).collect()} == {"never", "safe"}
    assert {r.id for r in state.collect()} == {1, 3, 4, 5, 6, 7}
    assert control.kept_requests(state, F.lit(at(2000)), 1000).count() == 0
    assert {(r.remoteid, r.ready) for r in positions.collect()} == {(7, True), (8, True), (9, False)}


def test_wait_aborts(spark):
    rows = [(1, at(1), 1, True, False, True), (1, at(2), 2, False, False, True), (1, at(3), 3, False, False, True), (1, at(4), 4, True, False, False), (1, at(5), 5, False, False, False), (2, at(1), 6, False, True, True), (3, at(1), 7, False, False, True)]
    log = spark.createDataFrame(rows, "remoteid long, ts timestamp, id long, ready boolean, launch boolean, waits boolean")
    assert sorted(r.id for r in acks.wait_aborts(log).collect()) == [2, 7]


def test_as_of_and_sessions_at_equal_times(spark):
    probes = spark.createDataFrame([(1, at(10), 1), (1, at(9), 2), (2, at(10), 3)], "remoteid long, ts timestamp, id long")
    changes = spark.createDataFrame([(1, at(10), 99, "on")], "remoteid long, ts timestamp, id long, state string")
    got = {r.id: r.state for r in sessions.value_as_of(probes, changes, "state").collect()}
    assert got == {1: "on", 2: None, 3: None}
    table = spark.createDataFrame(
        [(1, at(5), 50, at(10), 51), (1, at(10), 52, None, None)],
        "remoteid long, start_ts timestamp, start_id long, end_ts timestamp, end_id long",
    )
    inside = sessions.in_session(probes, table)
    assert {r.id: r.session_start for r in inside.collect()} == {1: at(10), 2: at(5)}
