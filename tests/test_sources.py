"""Files in, files out."""

import json
import struct

from pyspark.sql import functions as F

from thrustlog.registry.views import SENSOR_CONFIG
from thrustlog.sources import config, logs, packets

NAMES = ["Load Cell", "Tank Pressure"]


def test_read_logs_of_all_runs(spark, tmp_path):
    for label, first in (("24-Jan-05_10:20:30", 1.0), ("24-Jan-06_11:00:00", 2.0)):
        run = tmp_path / label
        run.mkdir()
        (run / "converted_data.csv").write_text(f"seconds,Load Cell,Tank Pressure\n0.001,{first},2\n0.002,,4\n")
        (run / "raw_data.csv").write_text("seconds,Load Cell,Tank Pressure\n0.001,9,9\n")
    got = logs.read_log(spark, str(tmp_path), NAMES).orderBy("run_id", "seconds").collect()
    assert [(r.run_id, r.seconds, r["Load Cell"], r["Tank Pressure"]) for r in got] == [
        ("24-Jan-05_10:20:30", 0.001, 1.0, 2.0), ("24-Jan-05_10:20:30", 0.002, None, 4.0),
        ("24-Jan-06_11:00:00", 0.001, 2.0, 2.0), ("24-Jan-06_11:00:00", 0.002, None, 4.0),
    ]
    raw = logs.read_raw_log(spark, str(tmp_path), NAMES)
    assert [r["Load Cell"] for r in raw.collect()] == [9.0, 9.0]
    assert logs.melt(raw, NAMES).count() == 4


def test_append_and_overwrite(spark, tmp_path):
    df = spark.createDataFrame(
        [("24-Jan-05_10:20:30", 0.1, 1.0, 2.0)], "run_id string, seconds double, `Load Cell` double, `Tank Pressure` double"
    )
    path = str(tmp_path / "log")
    logs.append_log(df, path)
    logs.append_log(df, path)
    back = logs.read_partitioned_log(spark, path, NAMES)
    assert back.count() == 2 and back.first().run_id == "24-Jan-05_10:20:30"
    logs.write_processed(df, path)
    assert logs.read_partitioned_log(spark, path, NAMES).count() == 1


def test_reports(spark, tmp_path):
    path = str(tmp_path / "reports")
    logs.write_reports(spark.createDataFrame([("a", "one\ntwo")], "run_id string, value string"), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["one", "two"]


def test_folders_of_many_runs_are_listed_by_few_tasks(spark, tmp_path):
    rows = spark.range(150).selectExpr("concat('run ', id) AS run_id", "0.2D AS seconds", "1D AS `Load Cell`", "2D AS `Tank Pressure`")
    path = str(tmp_path / "log")
    logs.append_log(rows.coalesce(1), path)
    given, status = spark.conf.get(logs.LISTING_TASKS), spark.sparkContext.statusTracker()
    for read, group in ((lambda: logs.read_partitioned_log(spark, path, NAMES), "by key"), (lambda: logs.read_log(spark, path, NAMES, "*.csv"), "by label")):
        spark.sparkContext.setJobGroup(group, "listing")
        try:
            back = read()
            jobs = [status.getJobInfo(job) for job in status.getJobIdsForGroup(group)]
            tasks = [status.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds]
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert tasks and max(tasks) <= 8 * spark.sparkContext.defaultParallelism
        assert back.select("run_id").distinct().count() == 150
    assert spark.conf.get(logs.LISTING_TASKS) == given


RUNS = "run_id string, seconds double, `Load Cell` double, `Tank Pressure` double"


def started_processes():
    """Processes that this machine has started so far."""
    with open("/proc/stat") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("processes "))


def test_files_of_many_runs_start_no_processes(spark, tmp_path):
    """Hadoop without its native library starts a process per new file and folder."""
    rows = spark.range(600).selectExpr("concat('run ', id) AS run_id", "0.2D AS seconds", "id * 1D AS `Load Cell`", "2D AS `Tank Pressure`").coalesce(1)
    path = str(tmp_path / "log")
    logs.append_log(rows.limit(1), path)
    before = started_processes()
    logs.append_log(rows, path)
    logs.write_processed(rows, path)
    assert started_processes() - before < 600
    back = logs.read_partitioned_log(spark, path, NAMES)
    assert back.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_folders_are_those_of_sparks_writer(spark, tmp_path):
    labels = ["24-Jan-05_10:20:30", "a b", "50%", "a+b", "a=b", "", None]
    rows = [(label, s / 5, value, -0.0) for label in labels for s, value in enumerate((1e-7, None, float("nan"), 1e22))]
    df = spark.createDataFrame(rows, RUNS)
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    logs.append_log(df, ours)
    df.repartition("run_id").write.partitionBy("run_id").option("header", True).csv(theirs)

    def content(path):
        files = [f for f in sorted((tmp_path / path).rglob("*.csv"))]
        return {f.parent.name: sorted(f.read_text().split("\n")) for f in files}

    assert content("ours") == content("theirs")
    schema = logs.wide_log(NAMES).add("run_id", "string")
    by_spark = spark.read.schema(schema).option("header", True).csv(ours)
    for path in (ours, theirs):
        back = logs.read_partitioned_log(spark, path, NAMES)
        assert [f.simpleString() for f in back.schema] == [f.simpleString() for f in by_spark.schema]
        assert sorted(map(str, back.collect())) == sorted(map(str, by_spark.collect())) and len(rows) == back.count()


def test_replaced_runs_leave_nothing_behind(spark, tmp_path):
    path = tmp_path / "processed"
    rows = spark.createDataFrame([(r, s / 5, 1.0, 2.0) for r in ("a", "b") for s in range(3)], RUNS)
    logs.write_processed(rows, str(path))
    logs.append_log(rows.where("run_id = 'a'"), str(path))
    assert logs.read_partitioned_log(spark, str(path), NAMES).count() == 9
    # what is read is replaced by what it gives
    logs.write_processed(logs.read_partitioned_log(spark, str(path), NAMES).where("run_id = 'a' AND seconds < 0.3"), str(path))
    assert sorted(f.name for f in path.iterdir()) == ["_SUCCESS", "run_id=a"]
    assert [f.name.startswith("part-") for f in (path / "run_id=a").iterdir()] == [True]
    assert sorted(r.seconds for r in logs.read_partitioned_log(spark, str(path), NAMES).collect()) == [0.0, 0.0, 0.2, 0.2]
    logs.write_processed(rows.limit(0), str(path))
    assert logs.read_partitioned_log(spark, str(path), NAMES).count() == 0


def test_failed_write_leaves_the_log_as_it_was(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(r, s / 5, 1.0, 2.0) for r in ("a", "b") for s in range(3)], RUNS)
    logs.append_log(rows.where("run_id = 'a'"), path)
    before = sorted(str(f) for f in (tmp_path / "log").rglob("*"))
    bad = rows.withColumn("Load Cell", F.when(F.col("run_id") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("Load Cell")))
    for write in (logs.append_log, logs.write_processed):
        try:
            write(bad, path)
        except Exception as error:
            assert "no" in str(error)
        else:
            raise AssertionError("it did not fail")
        assert sorted(str(f) for f in (tmp_path / "log").rglob("*")) == before


def test_loggers_files_are_read_as_spark_reads_them(spark, tmp_path, monkeypatch):
    from thrustlog.sources import run_folders

    texts = {
        "plain/x.csv": "seconds,Load Cell,Tank Pressure\n0.1,1,2\n0.2,3,4",
        "windows/x.csv": "seconds,Load Cell,Tank Pressure\r\n0.1,1,2\r\n\r\n0.2,3,4\r\n",
        "old/x.csv": "seconds,Load Cell,Tank Pressure\r0.1,1,2\r0.2,3,4\r",
        "odd/x.csv": "\ufeff\n  \nseconds,Load Cell,Tank Pressure\n\n0.1,abc,\n0.2\n0.3,\"5\",6,7\n \t\n0.4,1e-7,NaN\n",
        "long/deep/x.csv": "seconds,Load Cell,Tank Pressure\n" + "".join(f"{i / 10},{i},{-i}\n" for i in range(2000)),
        "header/x.csv": "seconds,Load Cell,Tank Pressure\n", "none/x.csv": "", "_hidden/x.csv": "seconds\n9,9,9\n", "other/x.txt": "seconds\n9,9,9\n",
        "plain/.x.csv": "seconds\n9,9,9\n",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    read = lambda: sorted(map(str, logs.read_log(spark, str(tmp_path), NAMES, "x.csv").collect()))
    ours = read()
    monkeypatch.setattr(run_folders, "local_path", lambda spark, path: None)
    assert ours == read() and len(ours) == 2 * 3 + 4 + 2000


def test_ranges_of_a_file_give_each_line_once(tmp_path):
    from thrustlog.sources import run_folders

    lines = [f"{i},{'x' * (i % 7)}".encode() for i in range(200)]
    for end in (b"", b"\n"):
        file = tmp_path / "log.csv"
        file.write_bytes(b"\n".join([b"head", *lines]) + end)
        size = file.stat().st_size
        for step in (1, 5, 64, size):
            ranges = [(a, min(a + step, size)) for a in range(0, size, step)]
            got = b"".join(t for a, b in ranges for t in run_folders._whole_lines(str(file), a, b))
            assert got == b"".join(line + b"\n" for line in lines)


def test_config_file(spark, tmp_path):
    (tmp_path / "sensors.json").write_text(SENSOR_CONFIG)
    read = config.read_config(spark, str(tmp_path / "sensors.json"))
    assert read.count() == 5
    config.write_config(read, str(tmp_path / "out"))
    text = spark.read.text(str(tmp_path / "out"), wholetext=True).first().value
    assert json.loads(text) == json.loads(SENSOR_CONFIG)
    assert list(json.loads(text)) == sorted(json.loads(text))
    fields = list(json.loads(text)["channel1"])
    assert fields == sorted(fields)


def test_packet_dumps(spark, tmp_path):
    run = tmp_path / "run-1"
    run.mkdir()
    (run / "0.bin").write_bytes(struct.pack("<4H", 1, 256, 4095, 65535))
    (run / "12.bin").write_bytes(struct.pack("<2H", 7, 8) + b"x")
    (run / "13.bin").write_bytes(b"")
    got = packets.read_packet_dumps(spark, str(tmp_path)).orderBy("batch_id").collect()
    assert [(r.run_id, r.batch_id, r.data) for r in got] == [
        ("run-1", 0, [1, 256, 4095, 65535]), ("run-1", 12, [7, 8]),
    ]


def test_cal_image(spark, tmp_path):
    image = bytearray(768)
    for channel in range(8):
        struct.pack_into("<2f", image, 8 * channel, 1 + channel / 10, -channel)
    image[0x40:0x46] = bytes([21, 5, 6, 7, 8, 9])
    image[0x2F8:0x300] = b"01ABCDEF"
    (tmp_path / "one.bin").write_bytes(bytes(image))
    rows = packets.read_cal_images(spark, str(tmp_path)).orderBy("channel").collect()
    assert [r.channel for r in rows] == list(range(8)) and {r.serial for r in rows} == {"01ABCDEF"}
    assert [round(r.slope, 5) for r in rows] == [round(1 + c / 10, 5) for c in range(8)]
    assert str(rows[0].cal_ts) == "2021-05-06 08:08:09"


def test_packets(spark, tmp_path):
    line = {"id": 1, "priority": "ACK", "decoded": {"requestId": 9}, "ts": "2024-01-01T00:00:00Z"}
    (tmp_path / "p.json").write_text(json.dumps(line))
    row = packets.read_packets(spark, str(tmp_path)).select("id", "decoded.requestId", F.year("ts").alias("y")).first()
    assert tuple(row) == (1, 9, 2024)
