"""A packet stream: damaged lines, two sinks from one checkpoint, a micro-batch that runs twice."""

import json
from datetime import datetime, timedelta

from pyspark.sql import types as T

from thrustlog.sources.packets import DAMAGED, stream_packets
from thrustlog.streaming import packets
from thrustlog.streaming.carried import BatchOutput, CarriedTable
from thrustlog.streaming.control import STAND_STATE

START = datetime(2024, 1, 1)


def line(i, second, command=None, stand=7, answers=None):
    decoded = {}
    if command:
        decoded["text"] = json.dumps({"remoteid": stand, "command": command})
    if answers is not None:
        decoded["requestId"] = answers
    ts = (START + timedelta(seconds=second)).isoformat() + "Z"
    return json.dumps({"id": i, "priority": "ACK" if answers is not None else "DEFAULT", "decoded": decoded, "ts": ts})


PARTS = [
    [line(1, 0, "ready"), line(2, 1, "fill-relay-on"), "no packet at all", line(3, 2, "launch", stand=None), "[1]"],
    [line(10, 5, answers=1), line(11, 50, "launch", stand=7), line(12, 55, "nonsense"), line(13, 56, answers=1)],
    [line(20, 62, "safe", stand=8), line(21, 100, answers=2), line(22, 110, answers=11)],
    ["{" * 40],
    [line(30, 300, "safe")],
]


class Outputs:
    def __init__(self, spark, base):
        self.stands = CarriedTable(spark, f"{base}/stands", T._parse_datatype_string(STAND_STATE))
        self.waiting = CarriedTable(spark, f"{base}/waiting", T._parse_datatype_string(packets.WAITING))
        self.timeline, self.answers, self.damaged = (BatchOutput(f"{base}/{n}") for n in ("timeline", "answers", "damaged"))

    def rows(self, spark):
        found = {
            "timeline": self.timeline.numbered(spark, "id long, state string, fill_solenoid boolean"),
            "answers": self.answers.numbered(spark, "id long, ts timestamp, ack_ts timestamp"),
            "damaged": self.damaged.numbered(spark, f"{DAMAGED} string"),
        }
        return {name: sorted(map(tuple, df.collect()), key=str) for name, df in found.items()}


def test_two_sinks_and_replay(spark, tmp_path):
    base = str(tmp_path)
    (tmp_path / "in").mkdir()
    out = Outputs(spark, base)
    again = []

    def start():
        stream = stream_packets(spark, f"{base}/in")
        return packets.receive(
            stream, out.stands, out.waiting, out.timeline, out.answers, out.damaged, f"{base}/checkpoint", availableNow=True
        )

    for n, part in enumerate(PARTS):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(part) + "\n")
        start().awaitTermination()
        if n == 2:  # the commit of this micro-batch is lost: it runs again
            again = out.rows(spark)
            (tmp_path / "checkpoint" / "commits" / "2").unlink()
            (tmp_path / "checkpoint" / "commits" / ".2.crc").unlink(missing_ok=True)
            start().awaitTermination()
            assert out.rows(spark) == again

    rows = out.rows(spark)
    assert [(r[0], r[1], r[2]) for r in rows["timeline"]] == [
        (1, "ready", False), (11, "ignition", False), (2, "ready", True), (20, "safe", False), (30, "safe", False),
    ]
    seconds = {r[0]: r[2] and int((r[2] - r[1]).total_seconds()) for r in rows["answers"]}
    # 2 was answered after its timeout, 3 and 12 never; 11 in a later micro-batch; 1 twice, the first one counts
    assert seconds == {1: 5, 2: None, 3: None, 11: 60, 12: None, 20: None}
    assert len(rows["answers"]) == 6
    assert [r[0] for r in rows["damaged"]] == ["[1]", "no packet at all", "{" * 40]
    assert [r.id for r in out.waiting.before(len(PARTS)).collect()] == [30]
