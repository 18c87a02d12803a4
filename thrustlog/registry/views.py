"""Telemetry views over the driver tables, in Spark and as SQL for the oracle.

Every view is derived row by row from a whole table, so its size grows with the table.
"""

from pyspark.sql import functions as F

from thrustlog.constants import FAST_MODEL
from thrustlog.operators.analysis import trace_with_gaps
from thrustlog.plans.scan import time_block
from thrustlog.session import spread
from thrustlog.sources.config import config_rows

RATE = 5
CHANNELS = 5
MAX_CODES = 30
RUN_SECONDS = 4

# The sample sensor configuration.
SENSOR_CONFIG = """{
 "channel0": {"channel": 0, "sensor_name": "Load Cell", "sensor_type": "loadcell", "units": "Newtons",
  "linear_adj": 8.291015625, "opamp_mul": 1, "scalar_adj": 1.4975323378209635, "min": 0, "max": 30.0,
  "input": {}},
 "channel1": {"channel": 1, "sensor_name": "Chamber Pressure", "sensor_type": "pressure", "units": "PSI",
  "linear_adj": -9.9951171875, "opamp_mul": 4.3, "scalar_adj": 1, "min": 0, "max": 1000,
  "input": {"max_psi": 1000}},
 "channel2": {"channel": 2, "sensor_name": "Tank Pressure", "sensor_type": "pressure", "units": "PSI",
  "linear_adj": -9.9951171875, "opamp_mul": 4.3, "scalar_adj": 1, "min": 0, "max": 1600,
  "input": {"max_psi": 1600}},
 "channel3": {"channel": 3, "sensor_name": "Tank Temperature", "sensor_type": "temp", "units": "Celsius",
  "linear_adj": -4.204709693884, "opamp_mul": 4.3, "scalar_adj": 1, "min": -100, "max": 40,
  "input": {}},
 "channel4": {"channel": 4, "sensor_name": "Chamber Temperature", "sensor_type": "temp", "units": "Celsius",
  "linear_adj": -4.18437550566343, "opamp_mul": 4.3, "scalar_adj": 1, "min": 20, "max": 750,
  "input": {}}
}"""
SENSOR_NAMES = [
    "Load Cell", "Chamber Pressure", "Tank Pressure", "Tank Temperature", "Chamber Temperature",
]


def table(spark, sf_dir, name):
    """A driver table; its timestamps without zone are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def event_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", (F.col("value") - 20).alias("y")
    )


def trace(spark, sf_dir):
    """Thrust trace per user: 5 samples a second in event order."""
    placed = trace_with_gaps(
        event_rows(spark, sf_dir).withColumn("t", F.lit(0.0)),
        ["ts", "event_id"],
        time_block(F.col("ts"), 3600),
    )
    return placed.withColumn("t", (F.col("pos") + 1) / F.lit(float(RATE)))


def commands(spark, sf_dir):
    kind, turn = F.col("event_type"), F.col("event_id") % 6
    others = ["fill-relay-on", "fill-relay-off", "dump-relay-on", "dump-relay-off",
              "start-cameras", "stop-cameras"]
    click = F.element_at(F.array(*[F.lit(c) for c in others]), (turn + 1).cast("int"))
    command = (
        F.when(kind == "signup", "ready")
        .when(kind == "error", "safe")
        .when(kind == "purchase", "launch")
        .when(kind == "view", "post-launch")
        .otherwise(click)
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("remoteid"), "ts", F.col("event_id").alias("id"),
        command.alias("command"),
    )


def micros(column):
    return F.unix_micros(F.col(column)).alias(f"{column}_us")


def raw_batches(spark, sf_dir):
    """One raw batch per order, its codes a ramp from the price; customers are runs."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    length = (key * 7) % (MAX_CODES + 1)

    first = (cents % 2048).cast("int")
    step = (F.lit(1) + F.col("o_custkey") % 60).cast("int")
    count = length.cast("int")
    data = F.slice(F.sequence(first, first + step * count, step), F.lit(1), count)
    status = F.when(key % 13 == 0, 6).when(key % 13 == 1, 0).otherwise(2)
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"
    )
    return spread(orders, "o_orderkey").select(
        F.col("o_custkey").alias("run_id"),
        key.alias("batch_id"),
        status.alias("status"),
        F.when(key % 4 == 0, 0).otherwise(1).alias("dport"),
        data.alias("data"),
        F.col("o_orderdate").alias("ts"),
    )


def run_settings(spark, sf_dir):
    """Sampling rate and device model of every run; customers are runs."""
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"),
        (F.lit(3) + nation % 5).alias("rate"),
        F.when(nation % 2 == 0, F.lit(FAST_MODEL)).otherwise(F.lit("")).alias("model"),
    )


def sensors(spark):
    text = spark.createDataFrame([(SENSOR_CONFIG,)], "value string")
    return config_rows(text)


VIEWS = {
    "trace": """trace AS (
  SELECT user_id AS run_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 5.0::DOUBLE AS t,
         value - 20 AS y
  FROM events)""",
    "commands": """commands AS (
  SELECT user_id AS remoteid, ts, event_id AS id,
         CASE event_type WHEN 'signup' THEN 'ready' WHEN 'error' THEN 'safe'
              WHEN 'purchase' THEN 'launch' WHEN 'view' THEN 'post-launch'
              ELSE CASE event_id % 6 WHEN 0 THEN 'fill-relay-on' WHEN 1 THEN 'fill-relay-off'
                   WHEN 2 THEN 'dump-relay-on' WHEN 3 THEN 'dump-relay-off'
                   WHEN 4 THEN 'start-cameras' ELSE 'stop-cameras' END END AS command
  FROM events)""",
    "raw_batches": """raw_batches AS (
  SELECT o_custkey AS run_id, o_orderkey AS batch_id,
         CASE o_orderkey % 13 WHEN 0 THEN 6 WHEN 1 THEN 0 ELSE 2 END AS status,
         CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS dport,
         (o_orderkey * 7) % 31 AS len,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         o_orderdate AS ts
  FROM orders)""",
    "codes": """codes AS (
  SELECT run_id, batch_id, status, dport, i // 5 AS scan, CAST(i % 5 AS INTEGER) AS channel,
         CAST(cents % 2048 + i * (1 + run_id % 60) AS INTEGER) AS code
  FROM (SELECT *, unnest(range(len)) AS i FROM raw_batches)
  WHERE i < (len // 5) * 5)""",
    "numbered": """numbered AS (
  SELECT *, row_number() OVER w AS transfer_no,
         CAST(coalesce(sum(len // 5) OVER (PARTITION BY run_id ORDER BY batch_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan_offset
  FROM raw_batches WINDOW w AS (PARTITION BY run_id ORDER BY batch_id))""",
    "readings": """readings AS (
  SELECT c.run_id, c.batch_id, n.scan_offset + c.scan + 1 AS scan_no,
         CAST(n.scan_offset + c.scan + 1 AS DOUBLE) / 5 AS seconds, c.channel, c.code,
         (c.code - 2048) * 10.0::DOUBLE / 2048.0::DOUBLE AS volts
  FROM codes c JOIN numbered n USING (run_id, batch_id))""",
    "sensors": """sensors AS (
  SELECT channel, sensor_name, sensor_type, units, CAST(linear_adj AS DOUBLE) AS linear_adj,
         CAST(opamp_mul AS DOUBLE) AS opamp_mul, CAST(scalar_adj AS DOUBLE) AS scalar_adj,
         CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, CAST(max_psi AS DOUBLE) AS max_psi
  FROM (VALUES
    (0, 'Load Cell', 'loadcell', 'Newtons', '8.291015625', '1', '1.4975323378209635', 0, 30, NULL),
    (1, 'Chamber Pressure', 'pressure', 'PSI', '-9.9951171875', '4.3', '1', 0, 1000, 1000),
    (2, 'Tank Pressure', 'pressure', 'PSI', '-9.9951171875', '4.3', '1', 0, 1600, 1600),
    (3, 'Tank Temperature', 'temp', 'Celsius', '-4.204709693884', '4.3', '1', -100, 40, NULL),
    (4, 'Chamber Temperature', 'temp', 'Celsius', '-4.18437550566343', '4.3', '1', 20, 750, NULL))
    AS s(channel, sensor_name, sensor_type, units, linear_adj, opamp_mul, scalar_adj, lo, hi, max_psi))""",
    "converted": """converted AS (
  SELECT r.*, sensor_name, units,
         CASE sensor_type WHEN 'loadcell' THEN (volts + linear_adj) / opamp_mul
              WHEN 'temp' THEN ((volts + linear_adj) / opamp_mul - 1.25) / 0.005::DOUBLE
              ELSE ((volts + linear_adj) / opamp_mul) / 4 * max_psi END * scalar_adj AS value
  FROM readings r JOIN sensors USING (channel))""",
    "timeline": """marked AS (
  SELECT *, sum(CASE WHEN command IN ('ready','safe','start-cameras','stop-cameras') THEN 1 ELSE 0 END)
           OVER w AS seg,
         coalesce(last_value(CASE WHEN command IN ('ready','safe','start-cameras','stop-cameras')
           THEN command END IGNORE NULLS) OVER w, 'safe') AS base
  FROM commands
  WINDOW w AS (PARTITION BY remoteid ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
launched AS (
  SELECT *, count(*) FILTER (command = 'launch' AND base = 'ready') OVER
           (PARTITION BY remoteid, seg ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nl
  FROM marked),
posted AS (
  SELECT *, count(*) FILTER (command = 'post-launch' AND nl > 0) OVER
           (PARTITION BY remoteid, seg ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS np
  FROM launched),
stated AS (
  SELECT *, CASE WHEN base <> 'ready' THEN base WHEN np > 0 THEN 'post-ignition'
              WHEN nl > 0 THEN 'ignition' ELSE 'ready' END AS state,
         command = 'launch' AND base = 'ready' AND nl = 1 AS fires,
         command = 'post-launch' AND np = 1 AS ends_burn
  FROM posted),
timeline AS (
  SELECT *, coalesce(lag(state) OVER (PARTITION BY remoteid ORDER BY ts, id), 'safe') AS state_before
  FROM stated),
relays AS (
  SELECT *,
    coalesce(last_value(CASE WHEN command = 'safe' OR fires OR command = 'fill-relay-off' THEN false
      WHEN command = 'fill-relay-on' THEN true END IGNORE NULLS) OVER w, false) AS fill_solenoid,
    coalesce(last_value(CASE WHEN command = 'safe' OR fires OR command = 'dump-relay-off' THEN false
      WHEN command = 'dump-relay-on' THEN true END IGNORE NULLS) OVER w, false) AS dump_solenoid,
    coalesce(last_value(CASE WHEN command = 'safe' OR ends_burn THEN false
      WHEN fires THEN true END IGNORE NULLS) OVER w, false) AS ignition,
    coalesce(last_value(CASE WHEN command = 'safe' THEN false
      WHEN command = 'ready' THEN true END IGNORE NULLS) OVER w, false) AS warn_lights
  FROM timeline
  WINDOW w AS (PARTITION BY remoteid ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "sessions": """session_marks AS (
  SELECT *, lag(command) OVER (PARTITION BY remoteid ORDER BY ts, id) AS before,
         first_value(CASE WHEN command = 'safe' THEN ts END IGNORE NULLS) OVER w AS end_ts,
         first_value(CASE WHEN command = 'safe' THEN id END IGNORE NULLS) OVER w AS end_id
  FROM commands WHERE command IN ('ready', 'safe')
  WINDOW w AS (PARTITION BY remoteid ORDER BY ts, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
sessions AS (
  SELECT remoteid, ts AS start_ts, id AS start_id, end_ts, end_id FROM session_marks
  WHERE command = 'ready' AND coalesce(before, 'safe') <> 'ready')""",
    "sent": """sent AS (
  SELECT remoteid, command, epoch_us(ts) // 86400000000 AS request, id, ts FROM commands
  WHERE command IN ('ready', 'safe', 'launch', 'post-launch')),
acks AS (
  SELECT event_id AS request_id, ts + to_seconds(event_id % 90) AS ts FROM events WHERE event_id % 3 = 0
  UNION ALL
  SELECT event_id, ts + to_seconds(2 * (event_id % 90) + 1) FROM events WHERE event_id % 6 = 0),
matched AS (
  SELECT s.remoteid, s.command, s.request, s.id, s.ts, min(a.ts) AS ack_ts
  FROM sent s LEFT JOIN acks a ON a.request_id = s.id AND a.ts > s.ts - INTERVAL 1 MICROSECOND
       AND a.ts <= s.ts + INTERVAL 60 SECOND
  GROUP BY ALL)""",
    "answers": """answers AS (
  SELECT s.remoteid, s.command, s.request, s.id, s.ts, min(a.ts) AS ack_ts
  FROM sent s LEFT JOIN acks a ON a.request_id = s.id AND a.ts >= s.ts
  GROUP BY ALL)""",
    "requests": """requests AS (
  SELECT *, coalesce(first_ack <= last_ts + INTERVAL 60 SECOND, false) AS done
  FROM (SELECT remoteid, command, request, count(*) AS attempts, max(ts) AS last_ts, min(ack_ts) AS first_ack
        FROM answers GROUP BY ALL))""",
    "aborted": """timeouts AS (
  SELECT a.remoteid, a.command, a.request, a.id, a.ts + INTERVAL 60 SECOND AS at
  FROM answers a JOIN requests r USING (remoteid, command, request)
  WHERE a.command <> 'safe' AND (r.first_ack IS NULL OR r.first_ack > a.ts + INTERVAL 60 SECOND)),
aborted AS (
  SELECT remoteid, command, request, min(id) AS id, abort_ts, 'safe' AS ends_in
  FROM (
    SELECT t.remoteid, t.command, t.request, t.id, t.at AS abort_ts,
           min(t.at) OVER (PARTITION BY t.remoteid, t.command, t.request) AS first_at
    FROM timeouts t ASOF LEFT JOIN switches s ON s.remoteid = t.remoteid AND t.at >= s.ts
    WHERE NOT coalesce(s.ready, false))
  WHERE abort_ts = first_at GROUP BY ALL)""",
    "switches": """switches AS (
  SELECT user_id AS remoteid, ts, event_id AS id, value > 10 AS ready, value > 30 AS launch,
         event_type IN ('view', 'click') AS fill, event_type = 'purchase' AS dump
  FROM events)""",
    "messages": """messages AS (
  SELECT id, ts, CASE
      WHEN id % 17 = 0 THEN left(text, 20)
      WHEN id % 41 = 0 THEN '[1, 2]'
      ELSE text END AS text, id % 7 = 0 AS is_ack
  FROM (SELECT id, ts, '{' ||
      CASE WHEN id % 31 = 0 THEN ''
           WHEN id % 29 = 0 THEN '"remoteid": null, '
           WHEN id % 23 = 0 THEN '"remoteid": "' || remoteid || '", '
           WHEN id % 37 = 0 THEN '"remoteid": ' || remoteid || '.0, '
           ELSE '"remoteid": ' || remoteid || ', ' END ||
      '"command": "' || CASE WHEN id % 19 = 0 THEN 'status' ELSE command END || '"' ||
      CASE WHEN id % 5 = 0 THEN ', "args": {"n": ' || id % 10 || '}' ELSE '' END || '}' AS text
    FROM commands)),
parsed AS (
  SELECT id, ts, CASE WHEN kind = 'NULL' THEN NULL
                      ELSE CAST(CAST(json_extract_string(text, '$.remoteid') AS DOUBLE) AS BIGINT) END AS remoteid,
         json_extract_string(text, '$.command') AS command,
         CAST(json_extract(text, '$.args') AS VARCHAR) AS args
  FROM (SELECT *, json_type(text, '$.remoteid') AS kind FROM messages
        WHERE json_valid(text) AND json_type(CASE WHEN json_valid(text) THEN text END) = 'OBJECT')
  WHERE kind IN ('NULL', 'UBIGINT', 'BIGINT', 'DOUBLE'))""",
}

NEEDS = {
    "codes": ["raw_batches"],
    "numbered": ["raw_batches"],
    "readings": ["codes", "numbered"],
    "converted": ["readings", "sensors"],
    "timeline": ["commands"],
    "sessions": ["commands"],
    "sent": ["commands"],
    "answers": ["sent"],
    "requests": ["answers"],
    "aborted": ["requests", "switches"],
    "messages": ["commands"],
}


def with_views(*names):
    """WITH clause of the named views and what they need, without the final query."""
    ordered = []

    def add(name):
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(VIEWS[name] for name in ordered)
