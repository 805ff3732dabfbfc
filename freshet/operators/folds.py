"""Ordered adjustments of flows: channel losses and gage enforcement.

Both are folds: step k scales the flows of a set of segments by a factor that depends on flows as they are then,
at one or two segments only. So the fold runs over those few segments, giving every step's factor, and each
segment's flow is multiplied by the factors of the steps that it belongs to, one after another in their order: results
are those of a plain loop to the last digit, and the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.operators.numbering import row_numbers
from freshet.scratch import cut, scope, tidy_shuffles


def scaled(flow: Column, scales: str) -> Column:
    """`flow` times the scales (order, scale) of the array `scales`, in order; a segment has one for each step that it belongs to."""
    return F.aggregate(F.array_sort(F.coalesce(F.col(scales), F.array())), flow, lambda q, s: q * s.scale)


#: Steps, and hits of theirs on the steps' ends, that one task folds at once.
FOLDED = 200_000


def loss_turns(steps: DataFrame, hits: DataFrame) -> tuple[DataFrame, int]:
    """`steps` with turn, and the number of turns: runs of steps in order that hold FOLDED steps and hits, or end with the step that goes beyond."""
    weighed = steps.join(hits.groupBy("step").agg(F.count(F.lit(1)).alias("n")), "step", "left").withColumn("n", 1 + F.coalesce("n", F.lit(0)))
    total = weighed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= FOLDED:
        return weighed.withColumn("turn", F.lit(0).cast("long")).drop("n"), min(total, 1)
    placed = cut(weighed.repartitionByRange("step").withColumn("part", F.spark_partition_id()), "loss-steps")
    base = placed.groupBy("part").agg(F.sum("n").alias("held")).selectExpr("part", "coalesce(sum(held) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    before = F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("step")) - F.col("n")
    turned = cut(placed.join(F.broadcast(base), "part").withColumn("turn", F.floor(before / FOLDED)).drop("part", "base", "n"), "loss-turns")
    return turned, turned.agg(F.max("turn")).first()[0] + 1


def _fold_losses(pdf: pd.DataFrame) -> pd.DataFrame:
    ends, steps = pdf[pdf.step.isna()], pdf[pdf.step.notna()].sort_values("step")
    at = {int(c): i for i, c in enumerate(ends.comid)}
    q = ends.q.to_numpy(float, na_value=np.nan).copy()
    hit: dict[int, list[int]] = {}
    for i, in_steps in enumerate(ends.in_steps):
        for k in in_steps if in_steps is not None else ():
            hit.setdefault(int(k), []).append(i)
    scales = []
    for k, up, ds, loss in zip(steps.step, steps.up, steps.ds, steps.loss):
        down = q[at[int(ds)]]
        scale = q[at[int(up)]] * (1.0 - loss) / down if down > 0 else 1.0
        scales.append(scale)
        q[hit.get(int(k), [])] *= scale
    return pd.DataFrame({"step": steps.step.astype("int64"), "scale": np.array(scales, float)})


def loss_scales(steps: DataFrame, members: DataFrame, flow: DataFrame) -> DataFrame:
    """step and scale for each control-point pair, in order of step.

    `steps` has step, up, ds, loss; `members` has step, comid: the path without its head; `flow` has comid, q.
    A step's factor is q_up (1 - loss) / q_ds if q_ds is over 0, else 1. A task folds one turn of steps, over the flows at
    their own ends; between turns the flows at all ends are brought up to date, so a river of any number of control
    points never makes a group over the bound.
    """
    with scope(steps.sparkSession) as held, tidy_shuffles(steps.sparkSession):
        turns = _folded_turns(steps, members, flow)
        held.keep(*turns)
    out = steps.sparkSession.createDataFrame([], "step long, scale double")
    for scales in turns:
        out = out.unionByName(scales)
    return out


def _folded_turns(steps: DataFrame, members: DataFrame, flow: DataFrame) -> list[DataFrame]:
    """The tables of loss_scales, one for each turn."""
    ends = steps.select(F.explode(F.array("up", "ds")).alias("comid")).distinct()
    # Hits beside the ends are those of members at ends only, so few steps have few rows.
    hits = cut(members.join(ends, "comid", "left_semi").select("step", "comid"), "loss-hits")
    steps, turns = loss_turns(steps, hits)
    q = ends.join(flow.select("comid", "q"), "comid", "left")
    if turns > 1:
        hits = cut(hits.join(steps.select("step", "turn"), "step"), "loss-hits", "turn")
        q = cut(q, "loss-flows")
    out = []
    for turn in range(turns):
        now = steps.where(F.col("turn") == turn).select("step", "up", "ds", "loss")
        used = now.select(F.explode(F.array("up", "ds")).alias("comid")).distinct()
        within = (hits.where(F.col("turn") == turn) if turns > 1 else hits).select("step", "comid")
        held = used.join(within.join(used, "comid", "left_semi").groupBy("comid").agg(F.collect_list("step").alias("in_steps")), "comid", "left").join(q, "comid", "left")
        rows = now.unionByName(held.select("comid", "q", "in_steps"), allowMissingColumns=True).withColumn("turn", F.lit(turn))
        scales = cut(rows.groupBy("turn").applyInPandas(_fold_losses, "step long, scale double"), "loss-scales")
        out.append(scales)
        if turn + 1 < turns:
            told = within.join(scales, "step").groupBy("comid").agg(F.collect_list(F.struct("step", "scale")).alias("scales"))
            q = cut(q.join(told, "comid", "left").select("comid", scaled(F.col("q"), "scales").alias("q")), "loss-flows")
    return out


def apply_losses(steps: DataFrame, members: DataFrame, flow: DataFrame) -> DataFrame:
    """Comid and q after all losses."""
    scales = members.join(loss_scales(steps, members, flow), "step").groupBy("comid").agg(F.collect_list(F.struct("step", "scale")).alias("scales"))
    return flow.join(scales, "comid", "left").select("comid", scaled(F.col("q"), "scales").alias("q"))


#: Pairs of gages above each other that are sent to every task; where there are more, they travel with the observations.
SENT_PAIRS = 1_000_000
#: Scales (months times gages) that are broadcast at once; where there are more, months go by turns.
SENT_SCALES = 4_000_000


def gage_slots(observations: DataFrame, reached: DataFrame) -> DataFrame:
    """date, comid, observed and slot of the observations in the network. A NaN is a gap of the flow file, not an observation.

    Slots number the gages from 0 in the order in which they are enforced, by gage_id and comid; a gage that is
    observed more than once in a month has a slot for each time, by the value.
    """
    inside = reached.select(F.col("src").alias("comid")).distinct()
    obs = observations.where(~F.isnan("flow_cms")).join(inside, "comid").select("date", "gage_id", "comid", F.col("flow_cms").alias("observed"))
    obs = cut(obs.withColumn("nth", F.row_number().over(Window.partitionBy("date", "gage_id", "comid").orderBy("observed"))), "gage-observations")
    slots = row_numbers(obs.select("gage_id", "comid", "nth").distinct(), ["gage_id", "comid", "nth"], "slot", first=0)
    return cut(obs.join(slots, ["gage_id", "comid", "nth"]).select("date", "comid", "observed", F.col("slot").cast("int").alias("slot")), "gage-slots")


def gage_scales(slots: DataFrame, reached: DataFrame, flow: DataFrame) -> DataFrame:
    """date and scales, the scale of every slot, of each date with observations, folded in the order of slots within the date.

    A slot without an observation in the month has 1. `slots` is what gage_slots gives; `reached` has src, comid for every gage's segment and those below; `flow` has date,
    comid, flow_cms. A group is one date's gages.
    """
    spark = slots.sparkSession
    inside = slots.select("comid").distinct()
    size = slots.agg(F.coalesce(F.max("slot") + 1, F.lit(0))).first()[0]
    rows = slots.join(flow.select("date", "comid", "flow_cms"), ["date", "comid"])
    pairs = cut(reached.join(inside, "comid", "left_semi").select("src", "comid"), "gage-pairs")
    sent = None
    if pairs.count() <= SENT_PAIRS:
        table = pairs.orderBy("src").toArrow()  # at most SENT_PAIRS
        sent = spark.sparkContext.broadcast((table["src"].to_numpy(), table["comid"].to_numpy()))
    else:
        rows = rows.join(pairs.groupBy("src").agg(F.collect_list("comid").alias("below")), F.col("comid") == F.col("src")).drop("src")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        if sent is None:
            below = dict(zip(pdf.comid, pdf.below))
        else:
            src, to = sent.value
            below = {c: to[slice(*np.searchsorted(src, [c, c + 1]))] for c in pdf.comid}
        comids = pdf.comid.unique()
        at = {c: i for i, c in enumerate(comids)}
        q = pdf.drop_duplicates("comid").flow_cms.to_numpy(float)
        hit = {c: [at[node] for node in below[c] if node in at] for c in comids}
        scales = []
        for comid, observed in zip(pdf.comid, pdf.observed):
            modeled = q[at[comid]]
            scale = 1.0 if modeled <= 0 else observed / modeled
            scales.append(scale)
            q[hit[comid]] *= scale
        every = np.ones(size)
        every[pdf.slot.to_numpy()] = scales
        return pd.DataFrame({"date": pdf.date.iloc[:1], "scales": [every]})

    return rows.groupBy("date").applyInPandas(fold, "date date, scales array<double>")


def enforce_gages(observations: DataFrame, reached: DataFrame, flow: DataFrame, at_gages: DataFrame | None = None) -> DataFrame:
    """G1: date, comid, flow_cms after enforcement; dates without observations stay as they are.

    `at_gages` is the same flow at the gages' segments, where that costs less than looking them up.
    """
    slots = gage_slots(observations, reached)
    own = cut(segment_slots(slots, reached), "segment-slots")
    below = flow.join(own, "comid", "left_semi").groupBy("comid").agg(F.collect_list(F.struct("date", "flow_cms")).alias("flows")).join(own, "comid")
    beside = flow.join(own, "comid", "left_anti").select("date", "comid", "flow_cms")
    return beside.unionByName(enforced_below(slots, reached, below, flow if at_gages is None else at_gages))


def segment_slots(slots: DataFrame, reached: DataFrame) -> DataFrame:
    """comid and slots, the slots of the gages at and above it in order, of every segment that has any."""
    of_gage = slots.select(F.col("comid").alias("src"), "slot").distinct()
    return reached.join(of_gage, "src").groupBy("comid").agg(F.sort_array(F.collect_list("slot")).alias("slots"))


def enforced_below(slots: DataFrame, reached: DataFrame, below: DataFrame, at_gages: DataFrame) -> DataFrame:
    """date, comid, flow_cms after enforcement of `below`: comid, slots (as segment_slots gives them) and flows, an array of date and flow_cms.

    A segment holds its slots and its months in one row, and is multiplied by the scales of its slots one after another, all
    months at once. No row by month and segment carries the month's scales: these would be as many as gages, months and segments multiplied.
    """
    scales = cut(gage_scales(slots, reached, at_gages), "gage-scales")
    sizes = scales.select("date", F.size("scales")).orderBy("date").collect()  # months of a run
    if not sizes:
        return below.select("comid", F.inline("flows")).select("date", "comid", "flow_cms")
    step = max(1, SENT_SCALES // sizes[0][1])
    dates = [r.date for r in sizes]
    out = None
    for i in range(0, len(dates), step):
        within = lambda d: (d >= F.lit(dates[i]) if i else F.lit(True)) & (d < F.lit(dates[i + step]) if i + step < len(dates) else F.lit(True))  # noqa: B023, E731
        part = _scaled_months(below.select("comid", "slots", F.filter("flows", lambda f: within(f.date)).alias("flows")), scales.where(within(F.col("date"))))
        out = part if out is None else out.unionByName(part)
    return out


def _scaled_months(below: DataFrame, scales: DataFrame) -> DataFrame:
    """date, comid, flow_cms of the flows of `below`, times the scales of their dates."""
    table = scales.orderBy("date").toArrow()  # at most SENT_SCALES numbers, or one month's
    by_slot = np.ascontiguousarray(table["scales"].combine_chunks().flatten().to_numpy().reshape(len(table), -1).T)
    sent = below.sparkSession.sparkContext.broadcast((table["date"].combine_chunks().cast(pa.int32()).to_numpy(), by_slot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        days, by_slot = sent.value
        for batch in batches:
            comid, slots, flows = batch.columns
            date, flow = flows.flatten().flatten()
            months, held = flows.value_lengths().to_numpy(), slots.value_lengths().to_numpy()
            day, slot, q = date.cast(pa.int32()).to_numpy(), slots.flatten().to_numpy(), flow.to_numpy(zero_copy_only=False).copy()
            column = np.searchsorted(days, day)
            known = days[np.minimum(column, len(days) - 1)] == day
            of_flow, of_slot = np.append(0, np.cumsum(months)), np.append(0, np.cumsum(held))
            for i in range(batch.num_rows):
                at = of_flow[i] + np.flatnonzero(known[of_flow[i] : of_flow[i + 1]])
                now, where = q[at], column[at]
                with np.errstate(over="ignore", invalid="ignore"):
                    for k in slot[of_slot[i] : of_slot[i + 1]]:
                        now *= by_slot[k, where]
                q[at] = now
            yield pa.RecordBatch.from_arrays([date, pa.array(np.repeat(comid.to_numpy(), months)), pa.array(q, mask=flow.is_null().to_numpy(zero_copy_only=False))], ["date", "comid", "flow_cms"])

    return below.mapInArrow(run, "date date, comid long, flow_cms double")
