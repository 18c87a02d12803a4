"""Sessions, switch edges and as-of lookups."""

from pyspark.sql import functions as F

from thrustlog.plans.scan import last_value, next_value, previous_value, running, time_block

ORDER = ("ts", "id")
BLOCK_SECONDS = 600


def sessions(commands, opens="ready", closes="safe", block_seconds=BLOCK_SECONDS):
    """Each opening command with the next closing one; a repeated opening opens nothing new.

    An open session has a null end.
    """
    command = F.col("command")
    marks = running(
        commands.where(command.isin(opens, closes)).select("remoteid", "ts", "id", "command"),
        ["remoteid"],
        ORDER,
        time_block(F.col("ts"), block_seconds),
        _before=previous_value(command),
        _end=next_value(F.when(command == closes, F.struct("ts", "id"))),
    )
    first = F.coalesce(F.col("_before") != opens, F.lit(True))
    return marks.where((command == opens) & first).select(
        "remoteid",
        F.col("ts").alias("start_ts"),
        F.col("id").alias("start_id"),
        F.col("_end.ts").alias("end_ts"),
        F.col("_end.id").alias("end_id"),
    )


def in_session(rows, session_table, key="remoteid", block_seconds=BLOCK_SECONDS):
    """Rows whose time lies in a session: from its start, before its end.

    Session starts and ends are laid between the rows and the nearest mark before a row is carried
    to it, so no range join and no pairs. At equal times a mark comes before the rows. ``rows``
    have ``key, ts, id``; the result adds ``session_start``.
    """
    columns = rows.columns
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns
               if c not in (key, "ts", "id")]
    no_start = F.lit(None).cast("timestamp")
    opening = F.struct(
        F.col("start_ts").alias("ts"), F.col("start_id").alias("id"),
        F.lit(1).alias("_rank"), F.col("start_ts").alias("_start"),
    )
    closing = F.struct(
        F.col("end_ts").alias("ts"), F.col("end_id").alias("id"),
        F.lit(0).alias("_rank"), no_start.alias("_start"),
    )
    marks = (
        session_table.select(key, F.explode(F.array(opening, closing)).alias("_mark"))
        .select(key, "_mark.*", *nothing)
        .where(F.col("ts").isNotNull())
    )
    mine = rows.select(*columns, F.lit(2).alias("_rank"), no_start.alias("_start"))
    both = mine.unionByName(marks)
    mark = F.when(
        F.col("_rank") < 2, F.struct((F.col("_rank") == 1).alias("open"), F.col("_start"))
    )
    carried = running(
        both,
        [key],
        ["ts", "_rank", "id"],
        time_block(F.col("ts"), block_seconds),
        _mark=last_value(mark),
    )
    return carried.where((F.col("_rank") == 2) & F.col("_mark.open")).select(
        *columns, F.col("_mark._start").alias("session_start")
    )


def value_as_of(probes, changes, value, key="remoteid", block_seconds=BLOCK_SECONDS):
    """Value in force at each probe: the last change at or before its time, else null.

    ``probes`` and ``changes`` have ``key, ts, id``; equal times count as already changed.
    """
    columns = probes.columns
    kind = changes.schema[value].dataType
    nothing = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in columns
               if c not in (key, "ts", "id")]
    mine = probes.select(
        *columns, F.lit(1).alias("_rank"), F.lit(None).cast(kind).alias("_value")
    )
    theirs = changes.select(
        key, "ts", "id", *nothing, F.lit(0).alias("_rank"), F.col(value).alias("_value")
    )
    carried = running(
        mine.unionByName(theirs),
        [key],
        ["ts", "_rank", "id"],
        time_block(F.col("ts"), block_seconds),
        **{value: last_value(F.col("_value"))},
    )
    return carried.where(F.col("_rank") == 1).select(*columns, value)


def switch_edges(switches, names, block_seconds=BLOCK_SECONDS):
    """Rows where a switch changed, as ``<name>-on`` and ``<name>-off``; switches start off.

    ``switches`` have ``remoteid, ts, id`` and one boolean per name.
    """
    before = running(
        switches,
        ["remoteid"],
        ORDER,
        time_block(F.col("ts"), block_seconds),
        **{f"_before_{n}": previous_value(F.col(n)) for n in names},
    )
    events = F.array(*[
        F.when(
            F.col(n) & ~F.coalesce(F.col(f"_before_{n}"), F.lit(False)), F.lit(f"{n}-on")
        ).when(~F.col(n) & F.coalesce(F.col(f"_before_{n}"), F.lit(False)), F.lit(f"{n}-off"))
        for n in names
    ])
    return before.select(
        "remoteid", "ts", "id", F.explode(F.array_compact(events)).alias("event")
    )


def recordings(commands, prefix="pi-hq", block_seconds=BLOCK_SECONDS):
    """Camera sessions with the name of their recording."""
    from thrustlog.functions.device import recording_name

    return sessions(commands, "start-cameras", "stop-cameras", block_seconds).withColumn(
        "recording", recording_name(prefix, F.col("start_ts"))
    )
