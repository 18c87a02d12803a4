"""Registered streams. Each feeds a driver table in four parts, one drained start per part, so the
carried state and the checkpoint are used, and returns what the stream has stored."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thrustlog.constants import COMMANDS, RELAYS
from thrustlog.operators import analysis as A
from thrustlog.operators import sessions as S
from thrustlog.registry import analysis as QA
from thrustlog.registry import commands as QC
from thrustlog.registry import decode as QD
from thrustlog.registry.convert import converted
from thrustlog.registry.views import (
    CHANNELS,
    RATE,
    RUN_SECONDS,
    VIEWS,
    commands,
    micros,
    raw_batches,
    sensors,
    table,
    with_views,
)
from thrustlog.plans.scan import time_block
from thrustlog.session import shared_folder, stored_table
from thrustlog.sources import dumps
from thrustlog.sources.packets import stream_packets
from thrustlog.streaming import acks as stream_ack
from thrustlog.streaming import control, ingest, packets, view
from thrustlog.streaming.carried import BatchOutput, CarriedTable


PARTS = 4
PACKET_TIMEOUT_SEC = 3 * 86_400


def feed(df, order, folder, start, write=None, parts=PARTS):
    """Write ``df`` in parts along ``order`` and drain the stream after each; last query returned.

    ``write`` puts a part in the folder in a form of its own, which ``start`` then has to read itself. ``df`` is
    computed once and stored, since its bounds and every part are taken from it; a part has a file per core at most.
    """
    spark = df.sparkSession
    df = stored_table(df, "feed").coalesce(spark.sparkContext.defaultParallelism)
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = (high - low) / parts
    query = None
    for part in range(parts):
        rows = df.where(F.col(order) >= F.lit(low + part * width)) if part else df
        if part < parts - 1:
            rows = rows.where(F.col(order) < F.lit(low + (part + 1) * width))
        if write:
            write(rows, folder)
        else:
            rows.write.mode("append").parquet(folder)
        query = start(None if write else spark.readStream.schema(df.schema).parquet(folder))
        query.awaitTermination()
    return query


def by_string_run(df):
    return df.withColumn("run_id", F.col("run_id").cast("string"))


def convert_stream(spark, sf_dir, name, batches, max_seconds, source=None, **fed):
    """The readings that a stream of raw batches leaves behind; files come in by bounded intake.

    ``source`` reads the folder that ``feed``, given ``fed``, puts the parts in; without it the files are Parquet.
    """
    base = shared_folder(spark, name)
    carried = CarriedTable(spark, f"{base}/runs", T._parse_datatype_string(ingest.RUN_STATE))
    output = BatchOutput(f"{base}/readings")
    source = source or (lambda folder: ingest.raw_batch_stream(spark, folder, schema=batches.schema))

    def start(_):
        return ingest.ingest(
            source(f"{base}/in"), sensors(spark), CHANNELS, RATE, carried, output, f"{base}/checkpoint",
            max_seconds=max_seconds, availableNow=True,
        )

    feed(batches, "batch_id", f"{base}/in", start, **fed)
    kept = "run_id string, arm_no long, scan_no long, sensor_name string, value double"
    return output.read(spark, kept).select(
        F.col("run_id").cast("long").alias("run_id"), "arm_no", "scan_no", "sensor_name",
        F.round("value", 6).alias("value"),
    )


def stream_convert(spark, sf_dir):
    batches = by_string_run(raw_batches(spark, sf_dir)).drop("ts")
    return convert_stream(spark, sf_dir, "stream-convert", batches, 0)


def stream_run_time(spark, sf_dir):
    """The same with the logger's run time switched on."""
    batches = by_string_run(raw_batches(spark, sf_dir)).drop("ts")
    return convert_stream(spark, sf_dir, "stream-run-time", batches, RUN_SECONDS)


def stream_dumps(spark, sf_dir):
    """The same from dump files of many batches, more of them per part than a micro-batch may take.

    A run lies in one file of a part, so its batches come in order whichever files are taken first.
    """
    files = spark.sparkContext.defaultParallelism
    batches = by_string_run(raw_batches(spark, sf_dir)).drop("ts")
    return convert_stream(
        spark, sf_dir, "stream-dumps", batches, 0,
        source=lambda folder: dumps.stream_dumps(spark, folder, files_per_trigger=max(files // 2, 1)),
        write=lambda rows, folder: dumps.write_dumps(rows.repartition(files, "run_id"), folder, "append"),
        parts=2,
    )


def stream_state(spark, sf_dir):
    base = shared_folder(spark, "stream-state")
    carried = CarriedTable(spark, f"{base}/stands", T._parse_datatype_string(control.STAND_STATE))
    output = BatchOutput(f"{base}/timeline")

    def start(stream):
        return control.run_state_machine(
            stream, carried, output, f"{base}/checkpoint", availableNow=True
        )

    feed(commands(spark, sf_dir), "ts", f"{base}/in", start)
    kept = "remoteid long, id long, state string, " + ", ".join(f"{r} boolean" for r in RELAYS)
    return output.read(spark, kept)


def write_packets(packets, folder):
    """Packets as lines of JSON; every 43rd line was cut short on its way."""
    line = F.to_json(F.struct(*packets.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    cut = F.when(F.col("id") % 43 == 0, F.expr("left(line, 30)")).otherwise(F.col("line"))
    packets.select("id", line.alias("line")).select(cut.alias("value")).write.mode("append").text(folder)


def received_packets(spark, sf_dir):
    """All that a stream of packet files leaves behind: timeline, answers, messages still waiting, damaged lines."""
    base = shared_folder(spark, "stream-packets")
    stands = CarriedTable(spark, f"{base}/stands", T._parse_datatype_string(control.STAND_STATE))
    waiting = CarriedTable(spark, f"{base}/waiting", T._parse_datatype_string(packets.WAITING))
    timeline, answers, damaged = (BatchOutput(f"{base}/{name}") for name in ("timeline", "answers", "damaged"))

    def start(_):
        return packets.receive(
            stream_packets(spark, f"{base}/in"), stands, waiting, timeline, answers, damaged, f"{base}/checkpoint",
            timeout_sec=PACKET_TIMEOUT_SEC, availableNow=True,
        )

    last = feed(QC.packets(spark, sf_dir), "ts", f"{base}/in", start, write=write_packets)
    return timeline, answers, waiting.before(last.lastProgress["batchId"] + 1), damaged


def stream_packet_timeline(spark, sf_dir):
    timeline, _, _, _ = received_packets(spark, sf_dir)
    kept = "remoteid long, id long, state string, " + ", ".join(f"{r} boolean" for r in RELAYS)
    return timeline.read(spark, kept)


def stream_packet_acks(spark, sf_dir):
    """Every message with its acknowledgement, answered in time or not, or still waiting at the end."""
    _, answers, waiting, _ = received_packets(spark, sf_dir)
    over = answers.read(spark, "id long, ts timestamp, ack_ts timestamp")
    open_now = waiting.withColumn("ack_ts", F.lit(None).cast("timestamp"))
    return over.unionByName(open_now).select("id", micros("ts"), micros("ack_ts"))


def stream_route(spark, sf_dir):
    base = shared_folder(spark, "stream-route")
    rows = commands(spark, sf_dir)

    def start(stream):
        return control.route_commands(stream, f"{base}/routed", f"{base}/checkpoint", availableNow=True)

    feed(rows, "ts", f"{base}/in", start)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    parts = [control.routed(spark, f"{base}/routed", schema, c).select("remoteid", "id", F.lit(c).alias("command")) for c in COMMANDS]
    return reduce(DataFrame.unionByName, parts)


def stream_acks(spark, sf_dir):
    """Sent messages and acknowledgements joined as streams.

    Two late rows on both sides end the feed: they move the watermark past all waiting messages.
    """
    base = shared_folder(spark, "stream-acks")
    rows = QC.sent(spark, sf_dir).select(
        F.lit("sent").alias("kind"), "id", F.lit(None).cast("long").alias("request_id"), "ts"
    ).unionByName(
        QC.acks(spark, sf_dir).select(
            F.lit("ack").alias("kind"), F.lit(None).cast("long").alias("id"), "request_id", "ts"
        )
    )
    folder = f"{base}/in"

    def start(stream):
        return (
            stream_ack.match_ack_streams(
                stream.where("kind = 'sent'").select("id", "ts"),
                stream.where("kind = 'ack'").select("request_id", "ts"),
            )
            .writeStream.format("parquet")
            .option("path", f"{base}/matched")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    feed(rows, "ts", folder, start)
    last = rows.agg(F.max("ts").alias("ts"))
    for day in (1, 2):
        late = last.withColumn("ts", F.col("ts") + F.make_dt_interval(days=F.lit(day)))
        ends = late.select(
            F.explode(F.array(F.lit("sent"), F.lit("ack"))).alias("kind"),
            F.lit(-day).cast("long").alias("id"), F.lit(-day).cast("long").alias("request_id"), "ts",
        )
        ends.write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()
    return (
        spark.read.schema("id long, sent_ts timestamp, ack_ts timestamp")
        .parquet(f"{base}/matched")
        .where("id >= 0")
        .select("id", micros("sent_ts"), micros("ack_ts"))
    )


def stream_view(spark, sf_dir):
    base = shared_folder(spark, "stream-view")
    carried = CarriedTable(spark, f"{base}/view", T._parse_datatype_string(view.VIEW_STATE))
    output = BatchOutput(f"{base}/shown")
    rows = by_string_run(converted(spark, sf_dir)).select(
        "run_id", "sensor_name", "scan_no", F.col("value").alias("y")
    )

    def start(stream):
        return view.live_view(
            stream, QC.VIEW_POINTS, carried, output, f"{base}/checkpoint", availableNow=True
        )

    query = feed(rows, "scan_no", f"{base}/in", start)
    return carried.before(query.lastProgress["batchId"] + 1).select(
        F.col("run_id").cast("long").alias("run_id"), "sensor_name", "scan_no",
        F.round("y", 6).alias("y"),
    )


def stream_resends(spark, sf_dir):
    """Sent messages, acknowledgements and switch rows in one stream; each micro-batch says what is due."""
    base = shared_folder(spark, "stream-resends")
    carried = CarriedTable(spark, f"{base}/open", T._parse_datatype_string(control.OPEN_ATTEMPT))
    positions = CarriedTable(spark, f"{base}/switches", T._parse_datatype_string(control.SWITCH_STATE))
    output = BatchOutput(f"{base}/due")
    nothing = {"request_id": F.lit(None).cast("long"), "ready": F.lit(None).cast("boolean")}
    sent = QC.sent(spark, sf_dir).withColumns(
        {"request": F.col("request").cast("string"), "kind": F.lit("sent"), **nothing}
    )
    answers = QC.acks(spark, sf_dir).withColumn("kind", F.lit("ack"))
    moved = QC.switches(spark, sf_dir).select("remoteid", "ts", "id", "ready", F.lit("switch").alias("kind"))
    rows = sent.unionByName(answers, allowMissingColumns=True).unionByName(moved, allowMissingColumns=True)

    def start(stream):
        return control.decide_resends(
            stream, carried, positions, output, f"{base}/checkpoint", availableNow=True
        )

    feed(rows, "ts", f"{base}/in", start)
    due = "remoteid long, command string, request string, attempts long, last_ts timestamp"
    return output.numbered(spark, due).select(
        "batch", "remoteid", "command", "request", "attempts", micros("last_ts")
    )


def session_summaries(spark, sf_dir, closed):
    """Run summary of each closed session over the stand's readings in it."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("remoteid"),
        (F.col("ts") + F.expr("INTERVAL 37 SECONDS")).alias("ts"),
        F.col("event_id").alias("id"),
        (F.col("value") - 20).alias("y"),
    )
    concerned = rows.join(closed.select("remoteid").distinct(), "remoteid", "left_semi")
    inside = S.in_session(concerned, closed).select(
        F.concat_ws("-", "remoteid", F.unix_micros("session_start")).alias("run_id"),
        "ts", "id", "y", F.lit(0.0).alias("t"),
    )
    placed = A.trace_with_gaps(inside, ["ts", "id"], time_block(F.col("ts"), 3600))
    timed = placed.withColumn("t", (F.col("pos") + 1) / F.lit(float(RATE)))
    return A.run_summary(stored_table(timed, "session-traces"), RATE, stored_table)


def session_run_summary(spark, sf_dir):
    closed = S.sessions(commands(spark, sf_dir)).where(F.col("end_ts").isNotNull())
    return QA.rounded_summary(session_summaries(spark, sf_dir, closed))


def stream_finish(spark, sf_dir):
    base = shared_folder(spark, "stream-finish")
    carried = CarriedTable(spark, f"{base}/open", T._parse_datatype_string(control.OPEN_SESSION))
    output = BatchOutput(f"{base}/summaries")
    closed = BatchOutput(f"{base}/sessions")
    schema = A.run_summary(
        spark.createDataFrame([], "run_id string, pos long, n long, t double, y double"), RATE
    ).schema

    def start(stream):
        return control.finish_runs(
            stream, lambda ended: session_summaries(spark, sf_dir, ended), carried, closed, output,
            f"{base}/checkpoint", availableNow=True,
        )

    feed(commands(spark, sf_dir), "ts", f"{base}/in", start)
    return QA.rounded_summary(output.read(spark, schema))


QUERIES = {
    "stream_convert": stream_convert,
    "stream_run_time": stream_run_time,
    "stream_dumps": stream_dumps,
    "stream_state": stream_state,
    "stream_packet_timeline": stream_packet_timeline,
    "stream_packet_acks": stream_packet_acks,
    "stream_route": stream_route,
    "stream_acks": stream_acks,
    "stream_view": stream_view,
    "stream_resends": stream_resends,
    "session_run_summary": session_run_summary,
    "stream_finish": stream_finish,
}

SESSION_TRACE = with_views("sessions") + """,
placed AS (
  SELECT s.remoteid || '-' || epoch_us(s.start_ts) AS run_id, e.ts, e.event_id, e.value - 20 AS y
  FROM events e JOIN sessions s ON s.remoteid = e.user_id AND e.ts + INTERVAL 37 SECOND >= s.start_ts
       AND e.ts + INTERVAL 37 SECOND < s.end_ts),
session_trace AS (
  SELECT run_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY run_id) AS n,
         CAST(row_number() OVER w AS DOUBLE) / 5.0::DOUBLE AS t, y
  FROM placed WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id))"""
SESSION_SUMMARY = (
    QA.analysed(SESSION_TRACE, "session_trace") + ",\n" + QA.SUMMARY + QA.SELECT_SUMMARY
)



def converted_sql(kept):
    return with_views("raw_batches", "sensors") + ",\n" + QD.ACCEPTED + f""",
codes AS (
  SELECT run_id, arm_no, scan_offset + i // 5 + 1 AS scan_no, CAST(i % 5 AS INTEGER) AS channel,
         (cents % 2048 + i * (1 + run_id % 60) - 2048) * 10.0::DOUBLE / 2048.0::DOUBLE AS volts
  FROM (SELECT *, unnest(range((len // 5) * 5)) AS i FROM accepted WHERE {kept}))
SELECT run_id, arm_no, scan_no, sensor_name,
       round(CASE sensor_type WHEN 'loadcell' THEN (volts + linear_adj) / opamp_mul
              WHEN 'temp' THEN ((volts + linear_adj) / opamp_mul - 1.25) / 0.005::DOUBLE
              ELSE ((volts + linear_adj) / opamp_mul) / 4 * max_psi END * scalar_adj, 6) AS value
FROM codes JOIN sensors USING (channel)"""


ORACLE = {
    "stream_convert": converted_sql("true"),
    "stream_dumps": converted_sql("true"),
    "stream_run_time": converted_sql(f"scan_offset / 5.0 <= {RUN_SECONDS}"),
    "stream_state": QC.ORACLE["relay_timeline"],
    "stream_packet_timeline": with_views("messages") + f""",
received AS (
  SELECT remoteid, ts, id, command FROM parsed
  WHERE command IN {QC.NAMES} AND remoteid IS NOT NULL AND id % 43 <> 0),
""" + VIEWS["timeline"].replace("FROM commands", "FROM received") + """
SELECT remoteid, id, state, fill_solenoid, dump_solenoid, ignition, warn_lights FROM relays""",
    "stream_packet_acks": with_views("commands") + f""",
arrived AS (SELECT * FROM commands WHERE id % 43 <> 0)
SELECT m.id, epoch_us(m.ts) AS ts_us, epoch_us(min(a.ts)) AS ack_ts_us
FROM arrived m LEFT JOIN arrived a ON a.id % 7 = 0 AND a.id - 1 = m.id AND a.ts >= m.ts
     AND a.ts <= m.ts + INTERVAL {PACKET_TIMEOUT_SEC} SECOND
GROUP BY m.id, m.ts""",
    "stream_route": with_views("commands") + """
SELECT remoteid, id, command FROM commands""",
    "stream_acks": with_views("sent") + """
SELECT id, epoch_us(ts) AS sent_ts_us, epoch_us(ack_ts) AS ack_ts_us FROM matched""",
    "stream_resends": with_views("sent", "switches") + f""",
arrivals AS (SELECT ts FROM sent UNION ALL SELECT ts FROM acks UNION ALL SELECT ts FROM switches),
spread AS (
  SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high, round_even((max(epoch_us(ts)) - min(epoch_us(ts))) / 4.0, 0)::BIGINT AS width
  FROM arrivals),
parts AS (
  SELECT p AS batch, low + p * width AS from_us, CASE WHEN p = 3 THEN high + 1 ELSE low + (p + 1) * width END AS to_us
  FROM spread, (SELECT unnest([0, 1, 2, 3]) AS p)),
clocks AS (
  SELECT batch, to_us, max(r.ts) AS now FROM parts
  JOIN arrivals r ON epoch_us(r.ts) >= from_us AND epoch_us(r.ts) < to_us GROUP BY ALL),
seen AS (
  SELECT c.batch, c.now, s.remoteid, s.command, s.request, s.id, s.ts, min(a.ts) AS ack_ts
  FROM clocks c JOIN sent s ON epoch_us(s.ts) < c.to_us
  LEFT JOIN acks a ON a.request_id = s.id AND a.ts >= s.ts AND epoch_us(a.ts) < c.to_us GROUP BY ALL),
asked AS (
  SELECT batch, now, remoteid, command, request, count(*) AS attempts, max(ts) AS last_ts, min(ack_ts) AS first_ack
  FROM seen GROUP BY ALL),
missed AS (
  SELECT s.batch, s.remoteid, s.command, s.request, s.ts + INTERVAL 60 SECOND AS at
  FROM seen s JOIN asked a USING (batch, remoteid, command, request)
  WHERE s.command <> 'safe' AND s.ts + INTERVAL 60 SECOND <= a.now AND (a.first_ack IS NULL OR a.first_ack > s.ts + INTERVAL 60 SECOND)),
safe_again AS (
  SELECT DISTINCT m.batch, m.remoteid, m.command, m.request
  FROM missed m ASOF LEFT JOIN switches w ON w.remoteid = m.remoteid AND m.at >= w.ts WHERE NOT coalesce(w.ready, false))
SELECT batch, remoteid, command, CAST(request AS VARCHAR) AS request, attempts, epoch_us(last_ts) AS last_ts_us
FROM asked ANTI JOIN safe_again USING (batch, remoteid, command, request)
WHERE NOT coalesce(first_ack <= last_ts + INTERVAL 60 SECOND, false) AND last_ts + INTERVAL 60 SECOND <= now
  AND last_ts + INTERVAL {control.RETENTION_SEC} SECOND >= now""",
    "stream_view": with_views("converted") + f"""
SELECT run_id, sensor_name, scan_no, round(value, 6) AS y
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sensor_name ORDER BY scan_no DESC) AS rank FROM converted)
WHERE rank <= {QC.VIEW_POINTS}""",
    "session_run_summary": SESSION_SUMMARY,
    "stream_finish": SESSION_SUMMARY,
}
