"""State machine, relays and sessions against a fold; micro-batches against the whole."""

import random
from datetime import datetime, timedelta

import pytest

from thrustlog.constants import COMMANDS, RELAYS
from thrustlog.operators.sessions import sessions
from thrustlog.operators.timeline import full_timeline
from thrustlog.streaming.control import (
    STAND_STATE,
    continue_sessions,
    continue_timeline,
    last_states,
)
from thrustlog.streaming.carried import replaced

SCHEMA = "remoteid long, ts timestamp, id long, command string"


def log(seed, count=600):
    rng = random.Random(seed)
    at, made = datetime(2024, 1, 1), []
    likely = COMMANDS + ["launch", "post-launch"] * 3 + ["ready"]
    for i in range(count):
        at += timedelta(seconds=rng.choice([0, 1, 30, 400]))
        stand = 1 if rng.random() < 0.5 else rng.randint(2, 5)
        made.append((stand, at, i, rng.choice(likely)))
    return made


def fold(made):
    stands, out = {}, {}
    for stand, at, number, command in sorted(made, key=lambda r: (r[1], r[2])):
        s = stands.setdefault(stand, {"state": "safe", **{r: False for r in RELAYS}})
        before = s["state"]
        if command in ("ready", "safe", "start-cameras", "stop-cameras"):
            s["state"] = command
        if command == "ready":
            s["warn_lights"] = True
        elif command == "safe":
            s.update({r: False for r in RELAYS})
        elif command == "launch" and before == "ready":
            s.update(state="ignition", fill_solenoid=False, dump_solenoid=False, ignition=True)
        elif command == "post-launch" and before == "ignition":
            s.update(state="post-ignition", ignition=False)
        elif command.startswith(("fill", "dump")):
            s[command[:4] + "_solenoid"] = command.endswith("on")
        out[number] = (before, s["state"], *[s[r] for r in RELAYS])
    return out


def shown(rows):
    return {r.id: (r.state_before, r.state, *[r[c] for c in RELAYS]) for r in rows.collect()}


@pytest.mark.parametrize("width", [1, 600, 10**8])
def test_timeline_equals_fold(spark, width):
    made = log(width)
    assert shown(full_timeline(spark.createDataFrame(made, SCHEMA), width)) == fold(made)


def test_micro_batches_equal_whole(spark):
    made = log(77)
    state = spark.createDataFrame([], STAND_STATE)
    seen = {}
    for part in range(4):
        batch = spark.createDataFrame(made[part * 150:(part + 1) * 150], SCHEMA)
        timeline = spark.createDataFrame(
            continue_timeline(batch, state).collect(), continue_timeline(batch, state).schema
        )
        seen.update(shown(timeline))
        after = replaced(state, last_states(timeline), ["remoteid"])
        state = spark.createDataFrame(after.collect(), STAND_STATE)
    assert seen == fold(made)


def session_fold(made):
    open_at, out = {}, []
    for stand, at, number, command in sorted(made, key=lambda r: (r[1], r[2])):
        if command == "ready" and stand not in open_at:
            open_at[stand] = number
        elif command == "safe" and stand in open_at:
            out.append((stand, open_at.pop(stand), number))
    return sorted(out + [(s, n, None) for s, n in open_at.items()], key=str)


def test_sessions(spark):
    made = log(5)
    got = sessions(spark.createDataFrame(made, SCHEMA), block_seconds=60)
    rows = sorted(((r.remoteid, r.start_id, r.end_id) for r in got.collect()), key=str)
    assert rows == session_fold(made)


def test_open_session_goes_on_in_next_batch(spark):
    t = datetime(2024, 1, 1)
    opened = spark.createDataFrame([(1, t, 1)], "remoteid long, ts timestamp, id long")
    more = [(1, t + timedelta(5), 2, "ready"), (1, t + timedelta(6), 3, "safe")]
    got = continue_sessions(spark.createDataFrame(more, SCHEMA), opened).collect()
    assert [(r.start_id, r.end_id) for r in got] == [(1, 3)]


def test_unknown_commands_change_nothing(spark):
    made = [(1, datetime(2024, 1, 1), 1, "ready"), (1, datetime(2024, 1, 2), 2, "dance")]
    got = full_timeline(spark.createDataFrame(made, SCHEMA)).orderBy("id").collect()
    assert [r.state for r in got] == ["ready", "ready"]
