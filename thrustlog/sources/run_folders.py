"""A folder per run with CSV files in it, written and read by the tasks themselves where the folders lie in a local or mounted file system.

Without its native library Hadoop starts a process for each new file and folder there, to set its permissions, and Spark's
reader keeps an entry per file on the driver and gives a task 32 files at most. Here a file costs its system calls. Lines
are made and parsed by Spark's CSV functions, so the files are those of Spark's writer. Other stores are left to Spark.
"""

import errno
import os
import re
import shutil
import uuid
from fnmatch import fnmatchcase
from itertools import batched, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
BLANK = bytes(range(33))
CHUNK = 4 << 20
RANGE = 32 << 20
FEW_FILES, MANY_FILES = 256, 8192
FOLDERS_PER_TASK = 2048
TASKS_PER_CORE = 8
LIST = "in-place"
MOVING_TASKS = 2  # a local file system moves one folder at a time, more tasks only wait


def local_path(spark, path):
    """``path`` in the file system that this machine shares with the executors, or nothing if it lies in another store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.makeQualified(place).toUri().getPath() if store.getScheme() == "file" else None


def escaped(value):
    """A value in a folder's name, as Spark writes it."""
    return value if value == NO_VALUE else re.sub(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda c: f"%{ord(c[0]):02X}", value)


def unescaped(name):
    return None if name == NO_VALUE else re.sub(r"%([0-9A-Fa-f]{2})", lambda c: chr(int(c[1], 16)), name)


def hidden(name):
    """Names that Spark's readers pass over."""
    return name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")


def _quoted(name):
    return F.col("`" + name.replace("`", "``") + "`")


def _text(column):
    """Bytes of a string array and where each of its values begins; the last entry is where the last one ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    return memoryview(data), np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()


def _file_names(partition, attempt, write_id):
    """The name of a file while it is written into a folder that was there before, and its own."""
    return f".part-{partition:05d}-{write_id}-{attempt}.csv", f"part-{partition:05d}-{write_id}.csv"


def _writer(keys, path, staging, write_id, header):
    """Writes the lines of sorted rows and gives the name of the task's own folder below ``staging``.

    New folders are made in it. Into folders that ``path`` has already the files go under hidden names; the task's
    list names these folders.
    """

    def write(batches):
        task = TaskContext.get()
        part, at, file = f"{task.partitionId()}-{task.taskAttemptId()}", None, None
        own = f"{staging}/{part}"
        hidden_name, name = _file_names(task.partitionId(), task.taskAttemptId(), write_id)
        os.makedirs(f"{own}/new")
        with open(f"{own}/{LIST}", "w", buffering=1, encoding="utf-8") as placed:
            try:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    columns = [batch.column(i) for i in range(len(keys))]
                    text, offsets = _text(batch.column(len(keys)))
                    new = np.zeros(batch.num_rows, bool)
                    for column in columns:
                        new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
                    cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
                    for first, last in zip(cuts, cuts[1:]):
                        key = [column[first].as_py() for column in columns]
                        if key != at:
                            if file:
                                file.close()
                            folder, at = "/".join(f"{k}={escaped(v)}" for k, v in zip(keys, key)), key
                            if os.path.isdir(f"{path}/{folder}"):
                                placed.write(f"{folder}\n")
                                file = open(f"{path}/{folder}/{hidden_name}", "wb")
                            else:
                                os.makedirs(f"{own}/new/{folder}")
                                file = open(f"{own}/new/{folder}/{name}", "wb")
                            file.write(header)
                        file.write(text[offsets[first] : offsets[last]])
            finally:
                if file:
                    file.close()
        yield pa.RecordBatch.from_pydict({"part": [part]})

    return write


def _in_place(path, staging, part, write_id):
    """Where a task wrote into folders of ``path``: hidden and final names."""
    hidden_name, name = _file_names(*map(int, part.split("-")), write_id)
    with open(f"{staging}/{part}/{LIST}", encoding="utf-8") as placed:
        for folder in placed.read().split("\n")[:-1]:
            yield f"{path}/{folder}/{hidden_name}", f"{path}/{folder}/{name}"


def _commit(path, staging, part, write_id):
    """Make a task's files visible; what an earlier attempt to do so has done stays done."""
    for source, target in _in_place(path, staging, part, write_id):
        try:
            os.rename(source, target)
        except FileNotFoundError:
            if not os.path.exists(target):
                raise
    _move(f"{staging}/{part}/new", path)


def _move(source, target):
    for entry in list(os.scandir(source)):
        to = f"{target}/{entry.name}"
        try:
            os.rename(entry.path, to)
        except FileNotFoundError:
            continue
        except OSError:
            if not (entry.is_dir() and os.path.isdir(to)):
                raise
            _move(entry.path, to)


def _drop_folder(path):
    """Remove a folder if it is empty."""
    try:
        os.rmdir(path)
    except OSError as error:
        if error.errno not in (errno.ENOTEMPTY, errno.EEXIST, errno.ENOENT, errno.ENOTDIR):
            raise


def _clear(path, names, write_id):
    """Remove the files in the folders of ``path``, other than those of this write; the folders are used again."""
    for name in names:
        if os.path.isdir(f"{path}/{name}") and not os.path.islink(f"{path}/{name}"):
            _clear(f"{path}/{name}", os.listdir(f"{path}/{name}"), write_id)
            if "=" not in name:
                _drop_folder(f"{path}/{name}")
        elif write_id not in name:
            os.remove(f"{path}/{name}")


def _prune(path, names):
    """Remove folders that stayed empty."""
    for name in names:
        if os.path.isdir(f"{path}/{name}"):
            _prune(f"{path}/{name}", os.listdir(f"{path}/{name}"))
            _drop_folder(f"{path}/{name}")


def write(rows, keys, path, replace=False):
    """Write ``rows``, which already lie by ``keys``, as CSV files in a folder per key.

    Readers see no file before all tasks have ended; then the files of those that count are made visible, so an attempt
    that failed or came second leaves nothing. ``replace`` removes what was there, only then, and keeps the folders that
    are needed again: making and removing a folder takes longer than its file.
    """
    spark = rows.sparkSession
    values = [c for c in rows.columns if c not in keys]
    header = spark.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(values)]))).first()[0]
    name = [F.coalesce(F.nullif(_quoted(k).cast("string"), F.lit("")), F.lit(NO_VALUE)).alias(k) for k in keys]
    line = F.concat(F.coalesce(F.to_csv(F.struct(*map(_quoted, values))), F.lit("")), F.lit("\n"))
    lines = rows.select(*name, line.alias("_line")).sortWithinPartitions(*map(_quoted, keys))

    write_id = uuid.uuid4().hex
    staging = f"{path}/_writing-{write_id}"
    os.makedirs(staging)
    parts = []
    try:
        write_part = _writer(keys, path, staging, write_id, f"{header}\n".encode())
        parts = [r.part for r in lines.mapInArrow(write_part, "part string").collect()]
        if replace:
            _clear(path, [name for name in os.listdir(path) if hidden(name) and write_id not in name], write_id)
            _top(spark, path).foreachPartition(lambda old: _clear(path, (r.name for r in old), write_id))
        if parts:
            moves = spark.sparkContext.parallelize(parts, min(MOVING_TASKS, len(parts)))
            moves.foreach(lambda part: _commit(path, staging, part, write_id))
        if replace:
            _top(spark, path).foreachPartition(lambda old: _prune(path, (r.name for r in old if r.is_folder)))
    finally:
        for part in set(os.listdir(staging)) - set(parts):
            for file, _ in _in_place(path, staging, part, write_id):
                if os.path.exists(file):
                    os.remove(file)
        shutil.rmtree(staging, ignore_errors=True)
    open(f"{path}/_SUCCESS", "wb").close()


def _top(spark, path):
    """Names in ``path``, dealt to as many tasks as they need, a few per core at most; one task lists the folder and keeps none of it."""

    def listed(batches):
        for batch in batches:
            for base in batch.column(0).to_pylist():
                with os.scandir(base) as entries:
                    for some in batched(((e.name, e.is_dir()) for e in entries if not hidden(e.name)), 8192):
                        yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*some))], ["name", "is_folder"])

    context = spark.sparkContext
    with os.scandir(path) as entries:
        count = sum(1 for _ in islice(entries, FOLDERS_PER_TASK * TASKS_PER_CORE * context.defaultParallelism))
    tasks = max(1, -(-count // FOLDERS_PER_TASK))
    base = spark.createDataFrame(context.parallelize([(path,)], 1), "base string")
    names = base.mapInArrow(listed, "name string, is_folder boolean")
    return names.repartition(tasks, "name")


def _walk(path):
    with os.scandir(path) as entries:
        for entry in entries:
            if not hidden(entry.name):
                if entry.is_dir():
                    yield from _walk(entry.path)
                else:
                    yield entry.path, entry.stat().st_size


FILE = "file string, size long, run_id string, arm_no string, depth int"
ARROW_FILE = pa.schema([("file", pa.string()), ("size", pa.int64()), ("run_id", pa.string()), ("arm_no", pa.string()), ("depth", pa.int32())])


def _files(spark, path, placed):
    """Files below ``path`` with the run, arming and depth that ``placed`` finds in their paths; it gives nothing for files to pass over."""

    def found(batches):
        for batch in batches:
            entries = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            files = (
                (file, size, *place)
                for name, is_folder in entries
                for file, size in (_walk(f"{path}/{name}") if is_folder else [(f"{path}/{name}", os.stat(f"{path}/{name}").st_size)])
                if (place := placed(file))
            )
            for some in batched(files, 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), ARROW_FILE)], schema=ARROW_FILE)

    return _top(spark, path).mapInArrow(found, FILE)


def _whole_lines(file, start, end):
    """The lines that begin in ``file`` from ``start`` to ``end``, in chunks that end with a line; without the header."""
    with open(file, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()
        rest, header, at = b"", start == 0, f.tell()
        while at < end:
            data = f.read(min(CHUNK, end - at))
            at = at + len(data) if data else end
            data = rest + data
            if at >= end:
                if not data.endswith(b"\n"):
                    data += f.readline()
                    data += b"" if data.endswith(b"\n") else b"\n"
                rest = b""
            else:
                cut = data.rfind(b"\n") + 1
                data, rest = data[:cut], data[cut:]
            if b"\r" in data:
                data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
            if header:
                data = data.removeprefix(b"\xef\xbb\xbf")
            while header and data:
                line, _, data = data.partition(b"\n")
                header = not line.strip(BLANK)
            if data:
                yield data


def _lines(texts, runs, arms):
    """A row per line that is not blank."""
    text = b"".join(texts)
    codes = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(codes == 10) + 1
    starts = np.concatenate([[0], ends[:-1]])
    counts = np.diff(np.searchsorted(ends, np.cumsum([len(t) for t in texts]), "right"), prepend=0)
    offsets = np.concatenate([starts, ends[-1:]]).astype(np.int32)
    of = pa.array(np.repeat(np.arange(len(texts)), counts))
    line = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(text))
    rows = pa.RecordBatch.from_arrays([line, pa.array(runs, pa.string()).take(of), pa.array(arms, pa.string()).take(of)], ["line", "run_id", "arm_no"])
    filled = np.ones(len(ends), bool)
    for i in np.flatnonzero(codes[starts] <= 32).tolist():
        filled[i] = bool(text[starts[i] : ends[i]].strip(BLANK))
    return rows if filled.all() else rows.filter(pa.array(filled))


def _reader(batches):
    for batch in batches:
        texts, runs, arms, held = [], [], [], 0
        for file, run, arm, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            for text in _whole_lines(file, start, end):
                texts.append(text)
                runs.append(run)
                arms.append(arm)
                held += len(text)
                if held >= CHUNK:
                    yield _lines(texts, runs, arms)
                    texts, runs, arms, held = [], [], [], 0
        if texts:
            yield _lines(texts, runs, arms)


def _read(spark, files, count, size, schema):
    """Rows of ``files``, large ones in ranges: the columns of ``schema``, then ``run_id`` and ``arm_no`` as text."""
    spread = min(spark.sparkContext.defaultParallelism, -(-count // FEW_FILES))
    tasks = max(1, spread, -(-size // RANGE), -(-count // MANY_FILES))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(RANGE).cast("long")))
    ranges = files.where("size > 0").select("file", "run_id", "arm_no", start.alias("start"), "size")
    ranges = ranges.withColumn("end", F.least(F.col("start") + RANGE, F.col("size"))).drop("size")
    lines = ranges.repartition(tasks, "file", "start").mapInArrow(_reader, "line string, run_id string, arm_no string")
    types = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    return lines.select(F.from_csv("line", types).alias("_row"), "run_id", "arm_no").select("_row.*", "run_id", "arm_no")


def _totals(files):
    whole = F.col("arm_no").rlike(r"^-?\d{1,18}$")
    return files.agg(
        F.count("*").alias("count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
        F.min("depth").alias("least"),
        F.max("depth").alias("most"),
        F.bool_and(whole).alias("whole_arms"),
        F.max(F.abs(F.col("arm_no").try_cast("long"))).alias("top_arm"),
    ).first()


def _folder(spark, path):
    """The folder of this file system that ``path`` names, if it names one and no pattern."""
    plain = isinstance(path, str) and not re.search(r"[*?\[{\\]", path)
    folder = local_path(spark, path) if plain else None
    return folder if folder and os.path.isdir(folder) else None


def read_by_label(spark, path, schema, file_name):
    """Files below ``path`` by the name of the folder above them, or nothing where that is left to Spark's reader."""
    folder = _folder(spark, path)
    if not folder or not file_name.endswith(".csv") or re.search(r"[\[{\\]", file_name):
        return None

    def placed(file):
        if fnmatchcase(file.rpartition("/")[2], file_name):
            run, arm = re.search(r"(?:run_id=)?([^/]+)(?:/arm_no=(\d+))?/[^/]+$", file).groups()
            return run, arm, 0
        return None

    files = _files(spark, folder, placed)
    totals = _totals(files)
    return _read(spark, files, totals["count"], totals.size, schema)


def read_by_key(spark, path, schema):
    """Files that ``write`` wrote by ``run_id`` and perhaps ``arm_no``, or nothing where the folder holds others or lies elsewhere."""
    folder = _folder(spark, path)
    if not folder:
        return None

    def placed(file):
        keys = re.fullmatch(r"/run_id=([^/]+)(?:/arm_no=([^/]+))?/[^/]+\.csv", file.removeprefix(folder))
        if not keys:
            return None, None, -1
        run, arm = keys.groups()
        return unescaped(run), arm and unescaped(arm), 1 if arm is None else 2

    files = _files(spark, folder, placed)
    totals = _totals(files)
    if totals["count"] == 0 or totals.least == -1 or totals.least != totals.most:
        return None
    rows = _read(spark, files, totals["count"], totals.size, schema)
    if totals.most == 1:
        return rows.drop("arm_no")
    if not totals.whole_arms or spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") != "true":
        return None
    return rows.withColumn("arm_no", F.col("arm_no").cast("int" if totals.top_arm < 2**31 else "long"))
