"""Registered command-log and live-view queries with their oracles."""

from pyspark.sql import functions as F

from thrustlog.constants import COMMANDS, RELAYS
from thrustlog.operators import acks as K
from thrustlog.operators import messages as M
from thrustlog.operators import sessions as S
from thrustlog.operators import timeline as L
from thrustlog.operators import view as V
from thrustlog.session import stored_table
from thrustlog.plans.scan import number_block, time_block
from thrustlog.registry.convert import converted
from thrustlog.registry.views import commands, micros, table, with_views

VIEW_POINTS = 40


def packets(spark, sf_dir):
    """Packets around the command log, some of them damaged; every seventh is an acknowledgement."""
    log = commands(spark, sf_dir)
    key = F.col("id")
    stand = F.col("remoteid").cast("string")
    address = (
        F.when(key % 31 == 0, "")
        .when(key % 29 == 0, '"remoteid": null, ')
        .when(key % 23 == 0, F.concat(F.lit('"remoteid": "'), stand, F.lit('", ')))
        .when(key % 37 == 0, F.concat(F.lit('"remoteid": '), stand, F.lit(".0, ")))
        .otherwise(F.concat(F.lit('"remoteid": '), stand, F.lit(", ")))
    )
    command = F.when(key % 19 == 0, "status").otherwise(F.col("command"))
    args = F.when(
        key % 5 == 0,
        F.concat(F.lit(', "args": {"n": '), (key % 10).cast("string"), F.lit("}")),
    ).otherwise("")
    text = F.concat(
        F.lit("{"), address, F.lit('"command": "'), command, F.lit('"'), args, F.lit("}")
    )
    damaged = (
        F.when(key % 17 == 0, F.substring(text, 1, 20))
        .when(key % 41 == 0, "[1, 2]")
        .otherwise(text)
    )
    return log.select(
        "id",
        F.when(key % 7 == 0, "ACK").otherwise("DEFAULT").alias("priority"),
        F.struct(
            damaged.alias("text"), F.when(key % 7 == 0, key - 1).alias("requestId")
        ).alias("decoded"),
        "ts",
    )


def parsed(spark, sf_dir):
    return M.parse_messages(M.text_messages(packets(spark, sf_dir)))


def ack_packets(spark, sf_dir):
    return M.acknowledgements(packets(spark, sf_dir)).select("request_id", micros("ts"))


def parse_messages(spark, sf_dir):
    return parsed(spark, sf_dir).select("id", micros("ts"), "remoteid", "command", "args")


def null_address(spark, sf_dir):
    return M.handler_arguments(M.addressed_to(parsed(spark, sf_dir), None))


def own_address(spark, sf_dir):
    return M.handler_arguments(M.known_commands(M.addressed_to(parsed(spark, sf_dir), 7)))


def known_commands(spark, sf_dir):
    return M.known_commands(parsed(spark, sf_dir)).select("id", "remoteid", "command")


def listed_commands(spark, sf_dir):
    listed = spark.createDataFrame([(c,) for c in COMMANDS], "command string")
    return M.listed_commands(parsed(spark, sf_dir), listed).select("id", "remoteid", "command")


def command_envelope(spark, sf_dir):
    key = F.col("id")
    address = F.when(key % 11 != 0, F.col("remoteid"))
    args = F.when(key % 3 == 0, F.col("command")).when(key % 3 == 1, "")
    return commands(spark, sf_dir).select(
        "id", M.command_envelope(address, F.col("command"), args).alias("text")
    )


def timeline(spark, sf_dir):
    return L.state_timeline(commands(spark, sf_dir))


def state_timeline(spark, sf_dir):
    return timeline(spark, sf_dir).select(
        "remoteid", micros("ts"), "id", "command", "state_before", "state"
    )


def relay_timeline(spark, sf_dir):
    return L.full_timeline(commands(spark, sf_dir)).select("remoteid", "id", "state", *RELAYS)


def ignition_audit(spark, sf_dir):
    return L.ignition_left_on(L.full_timeline(commands(spark, sf_dir))).select(
        "remoteid", "id", "command", "state"
    )


def sessions(spark, sf_dir):
    return S.sessions(commands(spark, sf_dir)).select(
        "remoteid", micros("start_ts"), "start_id", micros("end_ts"), "end_id"
    )


def recordings(spark, sf_dir):
    return S.recordings(commands(spark, sf_dir)).select(
        "remoteid", micros("start_ts"), micros("end_ts"), "recording"
    )


def readings_in_session(spark, sf_dir):
    """Events taken as readings 37 seconds after their time."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("remoteid"),
        (F.col("ts") + F.expr("INTERVAL 37 SECONDS")).alias("ts"),
        F.col("event_id").alias("id"),
        "value",
    )
    return S.in_session(rows, S.sessions(commands(spark, sf_dir))).select(
        "remoteid", micros("ts"), "id", "value", micros("session_start")
    )


def state_as_of(spark, sf_dir):
    """State in force 41 seconds after every event."""
    probes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("remoteid"),
        (F.col("ts") + F.expr("INTERVAL 41 SECONDS")).alias("ts"),
        F.col("event_id").alias("id"),
    )
    states = stored_table(timeline(spark, sf_dir).select("remoteid", "ts", "id", "state"), "states")
    return S.value_as_of(probes, states, "state").select(
        "remoteid", micros("ts"), "id", "state"
    )


def switches(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("remoteid"),
        "ts",
        F.col("event_id").alias("id"),
        (value > 10).alias("ready"),
        (value > 30).alias("launch"),
        kind.isin("view", "click").alias("fill"),
        (kind == "purchase").alias("dump"),
    )


def switch_edges(spark, sf_dir):
    return S.switch_edges(switches(spark, sf_dir), ["fill", "dump"]).select(
        "remoteid", "id", "event"
    )


def sent(spark, sf_dir):
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("long")
    return (
        commands(spark, sf_dir)
        .where(F.col("command").isin("ready", "safe", "launch", "post-launch"))
        .select("remoteid", "command", day.alias("request"), "id", "ts")
    )


def acks(spark, sf_dir):
    """Every third event is acknowledged, every sixth twice."""
    key = F.col("event_id")
    delay = key % 90

    def after(seconds):
        return (F.col("ts") + F.make_dt_interval(secs=seconds)).alias("ts")

    rows = table(spark, sf_dir, "events")
    first = rows.where(key % 3 == 0).select(key.alias("request_id"), after(delay))
    second = rows.where(key % 6 == 0).select(key.alias("request_id"), after(delay * 2 + 1))
    return first.unionByName(second)


def matched(spark, sf_dir):
    return K.match_acks(sent(spark, sf_dir), acks(spark, sf_dir))


def ack_match(spark, sf_dir):
    return matched(spark, sf_dir).select("id", "command", micros("ts"), micros("ack_ts"))


def unacked(spark, sf_dir):
    return K.unacknowledged(matched(spark, sf_dir)).select("id", "remoteid", "command")


def acknowledged_ids(spark, sf_dir):
    return K.acknowledged_ids(acks(spark, sf_dir))


REQUEST = list(K.REQUEST)


def answers(spark, sf_dir):
    """Stored once, because outcomes and aborts read it again."""
    return stored_table(K.answered(sent(spark, sf_dir), acks(spark, sf_dir)), "answers")


def request_outcome(spark, sf_dir):
    return K.request_outcome(answers(spark, sf_dir)).select(*REQUEST, "attempts", "done", micros("done_ts"))


def attempts(spark, sf_dir):
    return K.attempts(sent(spark, sf_dir), REQUEST).select(*REQUEST, "id", "attempt", "gap_sec")


def aborted_requests(spark, sf_dir):
    return K.aborted_requests(answers(spark, sf_dir), switches(spark, sf_dir)).select(*REQUEST, "id", micros("abort_ts"), "ends_in")


def wait_aborts(spark, sf_dir):
    """The state in force half a minute after every switch row tells whether the stand waits for launch."""
    rows = switches(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 SECONDS"))
    states = stored_table(timeline(spark, sf_dir).select("remoteid", "ts", "id", "state"), "states")
    placed = S.value_as_of(rows.select("remoteid", "ts", "id", "ready", "launch"), states, "state")
    log = placed.withColumn("waits", F.coalesce(F.col("state") == "ready", F.lit(False))).drop("state")
    return K.wait_aborts(log).select("remoteid", micros("ts"), "id", "ends_in")


def hold_aborts(spark, sf_dir):
    """Switches whose ready position follows the event type, so that it drops while launch is on."""
    log = switches(spark, sf_dir).withColumn("ready", ~F.col("dump"))
    return K.hold_aborts(log).select("remoteid", micros("ts"), "id", "ends_in")


def due_resends(spark, sf_dir):
    now = F.timestamp_micros(F.lit(1_705_276_800_000_000))
    log = answers(spark, sf_dir)
    aborted = K.aborted_requests(log, switches(spark, sf_dir))
    waiting = K.open_attempts(log, aborted=aborted)
    return K.due_resends(waiting, now).select(*REQUEST, "attempts", micros("last_ts"))


def latest(spark, sf_dir):
    return V.latest_points(
        converted(spark, sf_dir),
        ["run_id", "sensor_name"],
        ["scan_no"],
        number_block(F.col("scan_no"), 4096),
        VIEW_POINTS,
    )


def latest_n(spark, sf_dir):
    view = V.padded_view(latest(spark, sf_dir), "value", VIEW_POINTS)
    return view.select("run_id", "sensor_name", "place", F.round("value", 6).alias("value"))


def display_tail(spark, sf_dir):
    view = V.padded_view(latest(spark, sf_dir), "value", VIEW_POINTS)
    return V.drawn_parts(view, VIEW_POINTS).select(
        "run_id", "sensor_name", "place", F.round("value", 6).alias("value"), "line", "tail", "head"
    )


def latest_events(spark, sf_dir):
    """The last 40 events of every user, oldest first."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id", "value")
    return V.latest_points(
        rows, ["run_id"], ["ts", "event_id"], time_block(F.col("ts"), 3600), VIEW_POINTS
    ).select("run_id", "event_id", "value", "place")


QUERIES = {
    "ack_packets": ack_packets,
    "parse_messages": parse_messages,
    "null_address": null_address,
    "own_address": own_address,
    "known_commands": known_commands,
    "listed_commands": listed_commands,
    "command_envelope": command_envelope,
    "state_timeline": state_timeline,
    "relay_timeline": relay_timeline,
    "ignition_audit": ignition_audit,
    "sessions": sessions,
    "recordings": recordings,
    "readings_in_session": readings_in_session,
    "state_as_of": state_as_of,
    "switch_edges": switch_edges,
    "ack_match": ack_match,
    "unacked": unacked,
    "acknowledged_ids": acknowledged_ids,
    "request_outcome": request_outcome,
    "attempts": attempts,
    "aborted_requests": aborted_requests,
    "wait_aborts": wait_aborts,
    "hold_aborts": hold_aborts,
    "due_resends": due_resends,
    "latest_n": latest_n,
    "display_tail": display_tail,
    "latest_events": latest_events,
}

NAMES = "('" + "', '".join(COMMANDS) + "')"
KNOWN = with_views("messages") + f"""
SELECT id, remoteid, command FROM parsed WHERE command IN {NAMES}"""

VIEW = with_views("converted") + f""",
ranked AS (
  SELECT run_id, sensor_name, value,
         row_number() OVER (PARTITION BY run_id, sensor_name ORDER BY scan_no DESC) AS rank
  FROM converted),
sensors_seen AS (SELECT DISTINCT run_id, sensor_name FROM converted),
padded AS (
  SELECT s.run_id, s.sensor_name, CAST(p.place AS INTEGER) AS place, coalesce(r.value, 50) AS value
  FROM sensors_seen s CROSS JOIN range({VIEW_POINTS}) AS p(place)
  LEFT JOIN ranked r ON r.run_id = s.run_id AND r.sensor_name = s.sensor_name AND r.rank = {VIEW_POINTS} - p.place)"""

ORACLE = {
    "ack_packets": with_views("commands") + """
SELECT id - 1 AS request_id, epoch_us(ts) AS ts_us FROM commands WHERE id % 7 = 0""",
    "parse_messages": with_views("messages") + """
SELECT id, epoch_us(ts) AS ts_us, remoteid, command, args FROM parsed""",
    "null_address": with_views("messages") + """
SELECT id AS message_id, command AS message_command, args FROM parsed WHERE remoteid IS NULL""",
    "own_address": with_views("messages") + f"""
SELECT id AS message_id, command AS message_command, args FROM parsed WHERE remoteid = 7 AND command IN {NAMES}""",
    "known_commands": KNOWN,
    "listed_commands": KNOWN,
    "command_envelope": with_views("commands") + """
SELECT id, '{"remoteid":' || CASE WHEN id % 11 = 0 THEN 'null' ELSE CAST(remoteid AS VARCHAR) END
  || ',"command":"' || command || '"' || CASE WHEN id % 3 = 0 THEN ',"args":"' || command || '"' ELSE '' END || '}' AS text
FROM commands""",
    "state_timeline": with_views("timeline") + """
SELECT remoteid, epoch_us(ts) AS ts_us, id, command, state_before, state FROM timeline""",
    "relay_timeline": with_views("timeline") + """
SELECT remoteid, id, state, fill_solenoid, dump_solenoid, ignition, warn_lights FROM relays""",
    "ignition_audit": with_views("timeline") + """
SELECT remoteid, id, command, state FROM relays WHERE ignition AND state <> 'ignition'""",
    "sessions": with_views("sessions") + """
SELECT remoteid, epoch_us(start_ts) AS start_ts_us, start_id, epoch_us(end_ts) AS end_ts_us, end_id FROM sessions""",
    "recordings": with_views("commands") + """,
marks AS (
  SELECT *, lag(command) OVER (PARTITION BY remoteid ORDER BY ts, id) AS before,
         first_value(CASE WHEN command = 'stop-cameras' THEN ts END IGNORE NULLS) OVER
           (PARTITION BY remoteid ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_ts
  FROM commands WHERE command IN ('start-cameras', 'stop-cameras'))
SELECT remoteid, epoch_us(ts) AS start_ts_us, epoch_us(end_ts) AS end_ts_us,
       'pi-hq-' || (epoch_us(ts) // 1000000) || '.h264' AS recording
FROM marks WHERE command = 'start-cameras' AND coalesce(before, '') <> 'start-cameras'""",
    "readings_in_session": with_views("sessions") + """
SELECT e.user_id AS remoteid, epoch_us(e.ts + INTERVAL 37 SECOND) AS ts_us, e.event_id AS id, e.value,
       epoch_us(s.start_ts) AS session_start_us
FROM events e JOIN sessions s ON s.remoteid = e.user_id AND e.ts + INTERVAL 37 SECOND >= s.start_ts
     AND (s.end_ts IS NULL OR e.ts + INTERVAL 37 SECOND < s.end_ts)""",
    "state_as_of": with_views("timeline") + """
SELECT e.user_id AS remoteid, epoch_us(e.ts + INTERVAL 41 SECOND) AS ts_us, e.event_id AS id, t.state
FROM events e ASOF LEFT JOIN timeline t ON t.remoteid = e.user_id AND e.ts + INTERVAL 41 SECOND >= t.ts""",
    "switch_edges": with_views("switches") + """,
lagged AS (
  SELECT *, lag(fill, 1, false) OVER w AS fill_before, lag(dump, 1, false) OVER w AS dump_before
  FROM switches WINDOW w AS (PARTITION BY remoteid ORDER BY ts, id))
SELECT remoteid, id, CASE WHEN fill THEN 'fill-on' ELSE 'fill-off' END AS event FROM lagged WHERE fill <> fill_before
UNION ALL
SELECT remoteid, id, CASE WHEN dump THEN 'dump-on' ELSE 'dump-off' END FROM lagged WHERE dump <> dump_before""",
    "ack_match": with_views("sent") + """
SELECT id, command, epoch_us(ts) AS ts_us, epoch_us(ack_ts) AS ack_ts_us FROM matched""",
    "unacked": with_views("sent") + """
SELECT id, remoteid, command FROM sent s
WHERE NOT EXISTS (SELECT 1 FROM acks a WHERE a.request_id = s.id AND a.ts >= s.ts AND a.ts <= s.ts + INTERVAL 60 SECOND)""",
    "acknowledged_ids": with_views("sent") + """
SELECT DISTINCT request_id FROM acks""",
    "request_outcome": with_views("requests") + """
SELECT remoteid, command, request, attempts, done, CASE WHEN done THEN epoch_us(first_ack) END AS done_ts_us FROM requests""",
    "attempts": with_views("sent") + """
SELECT remoteid, command, request, id, row_number() OVER w AS attempt,
       (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6::DOUBLE AS gap_sec
FROM sent WINDOW w AS (PARTITION BY remoteid, command, request ORDER BY ts, id)""",
    "aborted_requests": with_views("aborted") + """
SELECT remoteid, command, request, id, epoch_us(abort_ts) AS abort_ts_us, 'safe' AS ends_in FROM aborted""",
    "wait_aborts": with_views("switches", "timeline") + """,
placed AS (
  SELECT w.remoteid, w.ts + INTERVAL 30 SECOND AS ts, w.id, w.ready, w.launch, t.state,
    lag(w.ready, 1, true) OVER (PARTITION BY w.remoteid ORDER BY w.ts, w.id) AS ready_before
  FROM switches w ASOF LEFT JOIN timeline t ON t.remoteid = w.remoteid AND w.ts + INTERVAL 30 SECOND >= t.ts)
SELECT remoteid, epoch_us(ts) AS ts_us, id, 'safe' AS ends_in FROM placed
WHERE state = 'ready' AND NOT launch AND NOT ready AND ready_before""",
    "hold_aborts": with_views("switches") + """,
lagged AS (
  SELECT *, lag(NOT dump AND launch, 1, false) OVER (PARTITION BY remoteid ORDER BY ts, id) AS held FROM switches)
SELECT remoteid, epoch_us(ts) AS ts_us, id, 'safe' AS ends_in FROM lagged WHERE launch AND dump AND held""",
    "due_resends": with_views("aborted") + """
SELECT remoteid, command, request, attempts, epoch_us(last_ts) AS last_ts_us
FROM requests ANTI JOIN aborted USING (remoteid, command, request)
WHERE NOT done AND last_ts + INTERVAL 60 SECOND <= TIMESTAMP '2024-01-15 00:00:00'""",
    "latest_n": VIEW + """
SELECT run_id, sensor_name, place, round(value, 6) AS value FROM padded""",
    "display_tail": VIEW + f"""
SELECT run_id, sensor_name, place, round(value, 6) AS value, true AS line,
       place >= {VIEW_POINTS - 10} AS tail, place = {VIEW_POINTS - 3} AS head
FROM padded WHERE place < {VIEW_POINTS - 2}""",
    "latest_events": f"""
SELECT user_id AS run_id, event_id, value, CAST({VIEW_POINTS} - rank AS INTEGER) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
WHERE rank <= {VIEW_POINTS}""",
}
