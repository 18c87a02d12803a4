"""The gates of a run as one composable scan.

Whether a batch counts depends on all batches of its run before it: is the run armed, how often has it been, has
the device reported an overrun since, how many transfers and scans are stored. Each run is cut into blocks of batch
numbers, and each block into pieces at the armings inside it. A piece is summed up without knowing what came
before (its first and last port, overruns, stored transfers and scans), and two neighbouring pieces compose, so the
scan over the pieces, a few rows per block, gives what enters each one. Rows move once, by run and block; the
codes ride along. A stream enters its carried state as one more piece in front of the run, and the state after
the micro-batch is the composition of all pieces.

A device whose port was never read counts as not armed; a null port counts as zero. Of rows alike in run and batch
number the order is not defined.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from thrustlog.constants import SCAN_OVERRUN, SCAN_RUNNING
from thrustlog.plans.scan import BLOCK, integer_div, number_block

BLOCK_WIDTH = 256
PIECE = "_piece"
LOCAL = ["_armed", "_open", "_usable", "_kept", "_overrun", "_in_piece_overruns", "_in_piece_transfers", "_in_piece_scans", "_whole"]
ENTER = ["arm_no", "open_kept", "open_lost", "overruns", "transfers", "scans", "open_transfers", "open_scans", "run_scans"]
PAST = -(1 << 63)


def _since_arming(rows, so_far, **values):
    """Add the number of the piece, and running sums of the values since it began.

    A sum over the block never falls, so what it was before the piece is the largest of its values at armings.
    """
    sums = {f"_sum{name}": F.sum(value).over(so_far) for name, value in values.items()}
    summed = rows.withColumns({PIECE: F.sum(F.col("_arms").cast("long")).over(so_far)} | sums)
    before = {
        name: F.coalesce(F.max(F.when(F.col("_arms"), F.col(f"_sum{name}") - value)).over(so_far), F.lit(0)) for name, value in values.items()
    }
    since = summed.withColumns({name: F.col(f"_sum{name}") - start for name, start in before.items()})
    return since.drop(*[f"_sum{name}" for name in values])


def in_blocks(batches, nchan, block_width=BLOCK_WIDTH):
    """Batches with their block, the piece of it, and what of the gates the block itself knows.

    ``_open`` marks a first batch with the port at zero: it is kept only if the run enters the block armed.
    """
    rows = batches.withColumns({
        BLOCK: number_block(F.col("batch_id"), block_width),
        "_armed": F.coalesce(F.col("dport") != 0, F.lit(False)),
        "_overrun": F.coalesce(F.col("status").bitwiseAND(F.lit(SCAN_OVERRUN)) != 0, F.lit(False)).cast("long"),
        "_usable": F.coalesce((F.col("status") == SCAN_RUNNING) & (F.size("data") > 0), F.lit(False)).cast("long"),
        "_whole": F.coalesce(integer_div(F.size("data"), nchan), F.lit(0).cast("long")),
    })
    order = Window.partitionBy("run_id", BLOCK).orderBy("batch_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.lag("_armed").over(order)).withColumns({
        "_arms": F.col("_armed") & ~F.coalesce("_before", F.lit(True)),
        "_kept": F.col("_armed") | F.coalesce("_before", F.lit(False)),
        "_open": F.col("_before").isNull() & ~F.col("_armed"),
    })

    rows = _since_arming(rows, so_far, _in_piece_overruns=F.col("_overrun") * F.col("_kept").cast("long"))
    stored = F.col("_usable") * (F.col("_kept") & (F.col("_in_piece_overruns") == 0)).cast("long")
    rows = _since_arming(rows, so_far, _in_piece_transfers=stored, _in_piece_scans=stored * F.col("_whole"))
    return rows.drop("_before", "_arms")


def pieces(rows):
    """One row per run, block and piece; the rows are where ``in_blocks`` has put them, so nothing moves."""
    opened = F.col("_open").cast("long")
    return rows.groupBy("run_id", BLOCK, PIECE).agg(
        F.min_by("_armed", "batch_id").alias("first_armed"),
        F.max_by("_armed", "batch_id").alias("last_armed"),
        F.max("_in_piece_overruns").alias("own_overruns"),
        F.max("_in_piece_transfers").alias("own_transfers"),
        F.max("_in_piece_scans").alias("own_scans"),
        F.sum(opened * F.col("_overrun")).alias("open_overruns"),
        F.sum(opened * F.col("_usable")).alias("open_transfers"),
        F.sum(opened * F.col("_usable") * F.col("_whole")).alias("open_scans"),
        F.lit(0).cast("long").alias("past_arms"),
    )


def carried_pieces(state):
    """The runs' carried state as pieces in front of all others."""
    def past(name):
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    none = F.lit(0).cast("long")
    armed = F.coalesce(F.col("past_armed"), F.lit(0)) != 0
    return state.select(
        "run_id", F.lit(PAST).alias(BLOCK), none.alias(PIECE), armed.alias("first_armed"), armed.alias("last_armed"),
        past("past_overruns").alias("own_overruns"), past("past_transfers").alias("own_transfers"), past("past_scans").alias("own_scans"),
        none.alias("open_overruns"), none.alias("open_transfers"), none.alias("open_scans"), past("past_arm_no").alias("past_arms"),
    )


def composed(found):
    """Pieces with what enters each: the arming it belongs to, and that arming's overruns, transfers and scans before it.

    ``transfers`` and ``scans`` are what came before, ``new_transfers`` and ``new_scans`` what the piece adds; an arming
    with an overrun adds nothing more. One row per block and arming goes into a window by run.
    """
    order = Window.partitionBy("run_id").orderBy(BLOCK, PIECE)
    past = F.col(BLOCK) == PAST
    entered = found.withColumn("_in", F.coalesce(F.lag("last_armed").over(order), F.lit(False)))
    arms = F.when(past, F.col("past_arms")).otherwise(((F.col(PIECE) > 0) | (F.col("first_armed") & ~F.col("_in"))).cast("long"))
    entered = entered.withColumns({
        "arm_no": F.sum(arms).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "open_kept": ~past & (F.col(PIECE) == 0) & F.col("_in"),
    }).withColumns({f"open_{x}": F.when(F.col("open_kept"), F.col(f"open_{x}")).otherwise(0) for x in ("overruns", "transfers", "scans")})
    lost = F.col("open_overruns") > 0
    added = entered.withColumns({
        "open_lost": lost,
        "_overruns": F.col("own_overruns") + F.col("open_overruns"),
        **{f"_{x}": F.when(lost, 0).otherwise(F.col(f"own_{x}") + F.col(f"open_{x}")) for x in ("transfers", "scans")},
    })
    arming = Window.partitionBy("run_id", "arm_no")
    before = arming.orderBy(BLOCK, PIECE).rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("overruns", F.coalesce(F.sum("_overruns").over(before), F.lit(0)))
    counts = F.col("overruns") == 0
    # what was carried over was counted before any overrun
    added = added.withColumns({f"new_{x}": F.when(counts | (F.col(BLOCK) == PAST), F.col(f"_{x}")).otherwise(0) for x in ("transfers", "scans")})
    return added.withColumns({
        "transfers": F.coalesce(F.sum("new_transfers").over(before), F.lit(0)),
        "scans": F.coalesce(F.sum("new_scans").over(before), F.lit(0)),
        "run_scans": F.sum("new_scans").over(arming),
    })


def accepted(rows, entering):
    """The batches of ``in_blocks`` that count, with ``arm_no``, ``transfer_no``, ``scan_offset`` and ``run_scans``."""
    columns = [c for c in rows.columns if c not in (BLOCK, PIECE, *LOCAL)]
    by_block = entering.where(F.col(BLOCK) != PAST).groupBy("run_id", BLOCK).agg(
        F.array_sort(F.collect_list(F.struct(PIECE, *ENTER))).alias("_pieces")
    )
    # every block has its row; the left join only keeps the planner from ever broadcasting the batches
    met = rows.join(by_block, ["run_id", BLOCK], "left").withColumn("_enter", F.get("_pieces", F.col(PIECE).cast("int"))).drop("_pieces")
    e = {name: F.col(f"_enter.{name}") for name in ENTER}
    kept = F.when(F.col("_open"), e["open_kept"]).otherwise(F.col("_kept") & ~e["open_lost"] & (F.col("_in_piece_overruns") == 0))
    counted = met.where((F.col("_usable") == 1) & (e["overruns"] == 0) & kept)

    def up_to(name, own):
        return e[name] + F.when(F.col("_open"), own).otherwise(e[f"open_{name}"] + F.col(f"_in_piece_{name}"))

    return counted.select(
        *columns, e["arm_no"].alias("arm_no"), up_to("transfers", F.lit(1)).alias("transfer_no"),
        (up_to("scans", F.col("_whole")) - F.col("_whole")).alias("scan_offset"), e["run_scans"].alias("run_scans"),
    )


def last_state(entering):
    """Per run: armed or not, how often armed, and the last arming's overruns, transfers and scans."""
    last = entering.groupBy("run_id").agg(F.max_by(
        F.struct(
            "arm_no", "last_armed", (F.col("overruns") + F.col("_overruns")).alias("overruns"),
            (F.col("transfers") + F.col("new_transfers")).alias("transfers"), (F.col("scans") + F.col("new_scans")).alias("scans"),
        ),
        F.struct(BLOCK, PIECE),
    ).alias("_last"))
    return last.select(
        "run_id", F.col("_last.transfers").alias("past_transfers"), F.col("_last.scans").alias("past_scans"),
        F.col("_last.overruns").alias("past_overruns"), F.col("_last.last_armed").cast("int").alias("past_armed"),
        F.col("_last.arm_no").alias("past_arm_no"),
    )
