"""Control state and relays of each stand over its command log.

``ready``, ``safe`` and the camera commands set the state from anywhere. ``launch`` counts only in
``ready`` and leads to ``ignition``; ``post-launch`` counts only in ``ignition``.

Commands have ``remoteid, ts, id, command`` with a non-null ``remoteid``. A row may carry a
``seed_state`` (any state) in place of a command: streams put the state a stand had before a
micro-batch in front of it this way.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from thrustlog.constants import INITIAL_STATE, RELAYS, STATE_SETTING_COMMANDS
from thrustlog.plans.scan import BLOCK, last_value, running, time_block

ORDER = ("ts", "id")
BLOCK_SECONDS = 600


def _state(base, launched, posted_after_launch, posted):
    """State after ``base``, given what followed it."""
    return (
        F.when(
            base == "ready",
            F.when(posted_after_launch > 0, "post-ignition")
            .when(launched > 0, "ignition")
            .otherwise("ready"),
        )
        .when(base == "ignition", F.when(posted > 0, "post-ignition").otherwise("ignition"))
        .otherwise(base)
    )


def _so_far(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _entry_states(last_rows):
    """State each block starts in, from the last row of every block."""
    key = Window.partitionBy("remoteid")
    across = key.orderBy(BLOCK)
    staged = last_rows.withColumn("_stage", F.count("_base").over(_so_far(across)))
    stage = Window.partitionBy("remoteid", "_stage")
    in_stage = stage.orderBy(BLOCK)
    sets_state = F.col("_base").isNotNull()
    own_exit = _state(
        F.col("_base"), F.col("_launched"), F.col("_posted_after"), F.col("_posted")
    )
    seeded = staged.withColumn(
        "_seed",
        F.coalesce(
            F.first(F.when(sets_state, own_exit), ignorenulls=True).over(_so_far(in_stage)),
            F.lit(INITIAL_STATE),
        ),
    )
    follows = ~sets_state
    launches = F.when(follows & (F.col("_launched") > 0), 1)
    seeded = seeded.withColumn(
        "_launched_before",
        F.count(launches).over(in_stage.rowsBetween(Window.unboundedPreceding, -1)),
    )
    closes = F.when(
        follows
        & F.when(F.col("_launched_before") > 0, F.col("_posted") > 0).otherwise(
            F.col("_posted_after") > 0
        ),
        1,
    )
    posts = F.when(follows & (F.col("_posted") > 0), 1)
    exit_state = _state(
        F.col("_seed"),
        F.count(launches).over(_so_far(in_stage)),
        F.count(closes).over(_so_far(in_stage)),
        F.count(posts).over(_so_far(in_stage)),
    )
    return seeded.withColumn("_exit", exit_state).select(
        "remoteid",
        BLOCK,
        F.lag("_exit", 1, INITIAL_STATE).over(across).alias("_entry"),
    )


def state_timeline(commands, block_seconds=BLOCK_SECONDS, keep_block=False):
    """Add ``state_before`` and ``state`` to every command row.

    ``keep_block`` keeps the block number, which lets ``relay_timeline`` reuse the partitioning.
    """
    columns = commands.columns
    command = F.col("command")
    seed = F.col("seed_state") if "seed_state" in columns else F.lit(None).cast("string")
    sets = F.coalesce(seed, F.when(command.isin(STATE_SETTING_COMMANDS), command))

    inside = Window.partitionBy("remoteid", BLOCK).orderBy(*ORDER)
    marked = (
        commands.withColumn(BLOCK, time_block(F.col("ts"), block_seconds))
        .withColumn("_sets", sets)
        .withColumn("_base", F.last("_sets", ignorenulls=True).over(_so_far(inside)))
        .withColumn("_segment", F.count("_sets").over(_so_far(inside)))
    )
    segment = _so_far(Window.partitionBy("remoteid", BLOCK, "_segment").orderBy(*ORDER))
    counted = (
        marked.withColumn("_launched", F.count(F.when(command == "launch", 1)).over(segment))
        .withColumn("_posted", F.count(F.when(command == "post-launch", 1)).over(segment))
        .withColumn(
            "_posted_after",
            F.count(F.when((command == "post-launch") & (F.col("_launched") > 0), 1)).over(segment),
        )
    )

    figures = ["_base", "_launched", "_posted", "_posted_after"]
    last_rows = counted.groupBy("remoteid", BLOCK).agg(
        F.max_by(F.struct(*figures), F.struct(*ORDER)).alias("_last")
    ).select("remoteid", BLOCK, *[F.col(f"_last.{c}").alias(c) for c in figures])

    entered = counted.join(_entry_states(last_rows), ["remoteid", BLOCK], "left")
    state = _state(
        F.coalesce(F.col("_base"), F.col("_entry")),
        F.col("_launched"),
        F.col("_posted_after"),
        F.col("_posted"),
    )
    return entered.withColumn("state", state).select(
        *columns,
        *([BLOCK] if keep_block else []),
        F.coalesce(F.lag("state").over(inside), F.col("_entry")).alias("state_before"),
        "state",
    )


def relay_effects(commands):
    """What each command does to each relay: on, off, or null for nothing.

    Needs ``state_before``. A row with ``seed_<relay>`` columns sets the relays to them.
    """
    command = F.col("command")
    fires = (command == "launch") & (F.col("state_before") == "ready")
    ends = (command == "post-launch") & (F.col("state_before") == "ignition")
    off, on = F.lit(False), F.lit(True)
    effects = {
        "fill_solenoid": F.when((command == "safe") | fires | (command == "fill-relay-off"), off)
        .when(command == "fill-relay-on", on),
        "dump_solenoid": F.when((command == "safe") | fires | (command == "dump-relay-off"), off)
        .when(command == "dump-relay-on", on),
        "ignition": F.when((command == "safe") | ends, off).when(fires, on),
        "warn_lights": F.when(command == "safe", off).when(command == "ready", on),
    }
    return {
        relay: F.coalesce(F.col(f"seed_{relay}"), effects[relay])
        if f"seed_{relay}" in commands.columns
        else effects[relay]
        for relay in RELAYS
    }


def relay_timeline(timeline, block_seconds=BLOCK_SECONDS):
    """Add the position of every relay after each row of a state timeline; all start off."""
    columns = [c for c in timeline.columns if c != BLOCK]
    kept = BLOCK in timeline.columns
    carried = running(
        timeline,
        ["remoteid"],
        ORDER,
        F.col(BLOCK) if kept else time_block(F.col("ts"), block_seconds),
        **{f"relay_{r}": last_value(effect) for r, effect in relay_effects(timeline).items()},
    )
    return carried.select(
        *columns, *[F.coalesce(F.col(f"relay_{r}"), F.lit(False)).alias(r) for r in RELAYS]
    )


def full_timeline(commands, block_seconds=BLOCK_SECONDS):
    """State and relays of every command row."""
    return relay_timeline(state_timeline(commands, block_seconds, keep_block=True), block_seconds)


def ignition_left_on(relays):
    """Audit: rows after which the ignition relay is on though the state is not ``ignition``."""
    return relays.where(F.col("ignition") & (F.col("state") != "ignition"))
