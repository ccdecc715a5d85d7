"""Diffusivity, drift and force of cells whose steps have unequal durations.

The posterior of such steps has no closed optimum, but at a given diffusivity it hangs on ten sums over the steps. So steps are written once as blocks of at most
BLOCK, whatever their cell, and each round sums every block at NODES diffusivities within its cell's bracket; sums are added up by cell and node, and the bracket
shrinks to the two nodes between which the slope of the cost turns. No task holds a cell, and nothing of the cells reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.operators.potential import SIGMA2
from stepfield.sources.storage import stored

BLOCK_BITS = 12
#: Diffusivities of the first round, over eight decades about the plain estimate, and of each later round.
SCAN, NODES, ROUNDS = 81, 41, 5
_SUMS = ("log_s", "t_s", "x_s", "y_s", "tt_s", "r_s", "tr_s", "tx_s", "ty_s", "ttt_s")


def _summed(nodes: int, sigma2: float):
    """Blocks with their cell's bracket -> the sums at each node, those of a batch's blocks added up by cell."""

    def run(batches):
        for b in batches:
            cells, low, high = (b.column(c).to_numpy() for c in ("cell", "low", "high"))
            at, flat = b.column("steps").offsets.to_numpy(), b.column("steps").values
            dx, dy, dt = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("dx", "dy", "dt"))
            total: dict[int, np.ndarray] = {}
            for n, cell in enumerate(cells.tolist()):
                x, y, t = (v[at[n] : at[n + 1]] for v in (dx, dy, dt))
                s = np.exp(np.linspace(low[n], high[n], nodes))[:, None] * t + sigma2
                w, r = 1 / s, x * x + y * y
                w2 = w * w
                sums = np.stack([np.log(s).sum(1), w @ t, w @ (t * x), w @ (t * y), w @ (t * t), w @ r, w2 @ (t * r), w2 @ (t * t * x), w2 @ (t * t * y), w2 @ (t * t * t)])
                total[cell] = total[cell] + sums if cell in total else sums
            if total:
                arrays = [pa.array(np.repeat(np.array(list(total), np.int32), nodes)), pa.array(np.tile(np.arange(nodes, dtype=np.int32), len(total)))]
                every = np.concatenate(list(total.values()), axis=1)
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(v) for v in every)], names=["cell", "node", *_SUMS])

    return run


def infer_any_dt(steps: DataFrame, mode: str = "d", sigma2: float = SIGMA2, jeffreys: bool = False) -> DataFrame:
    """steps (cell, dx, dy, dt) -> (cell, k, diffusivity, a_x, a_y): the optimum for steps of any positive durations; a is zero in mode d, the drift in dd, the
    force in df. Steps with a null, or of no duration, don't count; a cell without any other has no row."""
    given = steps.select(F.col("cell").cast("int").alias("cell"), *(F.col(c).cast("double").alias(c) for c in ("dx", "dy", "dt"))).dropna().where("dt > 0")
    given = stored(given.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "steps")
    blocks = stored(given.groupBy("cell", "block").agg(F.collect_list(F.struct("dx", "dy", "dt")).alias("steps")).drop("block"), "blocks")
    rough = F.log(F.greatest(F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (4 * F.sum("dt")), F.lit(1e-12)))
    now = given.groupBy("cell").agg(F.count("*").alias("k"), F.avg("dt").alias("mean"), (rough + float(np.log(1e-6))).alias("low"), (rough + float(np.log(1e2))).alias("high"))
    now = stored(now.withColumns({"a_x": F.lit(0.0), "a_y": F.lit(0.0)}), "brackets")
    for n in range(ROUNDS + 1):
        nodes = NODES if n else SCAN
        schema = "cell int, node int, " + ", ".join(f"{c} double" for c in _SUMS)
        sums = blocks.join(now.select("cell", "low", "high"), "cell").mapInArrow(_summed(nodes, sigma2), schema).groupBy("cell", "node").agg(*(F.sum(c).alias(c) for c in _SUMS))
        width = (F.col("high") - F.col("low")) / (nodes - 1)
        at = sums.join(now.drop("a_x", "a_y"), "cell").withColumn("d", F.exp(F.col("low") + F.col("node") * width))
        free = F.lit(0.0 if mode == "d" else 1.0)
        at = at.withColumns({"a_x": free * F.col("x_s") / F.col("tt_s"), "a_y": free * F.col("y_s") / F.col("tt_s")})
        square = F.col("a_x") * F.col("a_x") + F.col("a_y") * F.col("a_y")
        cost = F.col("log_s") + (F.col("r_s") - square * F.col("tt_s")) / 4
        slope = F.col("t_s") - (F.col("tr_s") - 2 * (F.col("a_x") * F.col("tx_s") + F.col("a_y") * F.col("ty_s")) + square * F.col("ttt_s")) / 4
        if jeffreys:
            s = F.col("d") * F.col("mean") + sigma2
            cost, slope = cost + 2 * F.log(s), slope + 2 * F.col("mean") / s
            if mode == "df":
                cost, slope = cost - 2 * F.log("d"), slope - 2 / F.col("d")
        # The scan brackets the least cost by its neighbours; later rounds take the last node from which the cost falls, and the next.
        first = F.greatest(F.lit(0), (F.min_by("node", "cost") - 1) if n == 0 else F.coalesce(F.max(F.when(F.col("slope") < 0, F.col("node"))), F.lit(0)))
        one = at.withColumns({"cost": cost, "slope": slope}).groupBy("cell", "k", "mean", "low", "high").agg(first.alias("first"), *(F.sort_array(F.collect_list(F.struct("node", c))).alias(c) for c in ("a_x", "a_y")))
        one = one.withColumn("first", F.least("first", F.lit(nodes - (1 if n == 0 else 2))))
        last = F.least(F.col("first") + (2 if n == 0 else 1), F.lit(nodes - 1))
        now = stored(one.select("cell", "k", "mean", (F.col("low") + F.col("first") * width).alias("low"), (F.col("low") + last * width).alias("high"), *(F.col(c)[F.col("first")][c].alias(c) for c in ("a_x", "a_y"))), "brackets")
    out = now.withColumn("diffusivity", F.exp((F.col("low") + F.col("high")) / 2))
    per = F.col("diffusivity") if mode == "df" else F.lit(1.0)
    return out.select("cell", "k", "diffusivity", (F.col("a_x") / per).alias("a_x"), (F.col("a_y") / per).alias("a_y"))
