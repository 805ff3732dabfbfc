"""Routing, levels, reach, losses, gages and calibration: hand-checked cases, and random networks against plain loops."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from freshet import scratch
from freshet.operators import control_points, folds, gages, joins, nearest, network, runoff
from freshet.plans import contract

CHAIN = [(1, 2), (2, 3)]
Y = [(1, 3), (2, 3), (3, 4)]
DIAMOND = [(1, 2), (1, 3), (2, 4), (3, 4)]


def edge_table(spark, pairs):
    return spark.createDataFrame(pairs, "up long, ds long")


def flow_table(spark, values):
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "comid long, q double")


def as_list(df):
    return [r.q for r in df.orderBy("comid").collect()]


@pytest.mark.parametrize(
    ("pairs", "local", "expected"),
    [(CHAIN, (1, 2, 4), (1, 3, 7)), (Y, (1, 2, 4, 8), (1, 2, 7, 15)), (DIAMOND, (1, 10, 100, 1000), (1, 11, 101, 1112)), ([], (5, 6), (5, 6))],
)
def test_accumulate(spark, pairs, local, expected):
    assert as_list(network.accumulate(flow_table(spark, local), network.powers(edge_table(spark, pairs), len(local)))) == list(expected)


@pytest.mark.parametrize(("pairs", "local", "unknown"), [(CHAIN, (None, 1, 1), {1, 2, 3}), (Y, (1, None, 1, 1), {2, 3, 4}), (DIAMOND, (1, 1, None, 1), {3, 4}), (CHAIN, (1, 1, float("nan")), {3})])
def test_an_unknown_area_spreads_downstream(spark, pairs, local, unknown):
    areas = spark.createDataFrame([(i + 1, None if v is None else float(v)) for i, v in enumerate(local)], "comid long, q double")
    got = network.accumulate(areas, network.powers(edge_table(spark, pairs), len(local))).collect()
    assert {r.comid for r in got if r.q != r.q} == unknown and all(r.q is not None for r in got)


def test_edges_follow_hydroseq(spark):
    cases = [(6.0, 4.0), (5.0, 5.0), (4.0, 6.0), (None, 4.0), (4.0, None)]
    rows = []
    for i, (up, ds) in enumerate(cases):
        rows += [(10 * i + 1, 100.0 * i + 1, 100.0 * i + 2, up), (10 * i + 2, 100.0 * i + 2, 100.0 * i + 3, ds)]
    got = network.edges(spark.createDataFrame(rows, "comid long, fromnode double, tonode double, hydroseq double"))
    assert sorted(r.up // 10 for r in got.collect()) == [0, 3, 4]


@pytest.mark.parametrize("pairs", [[(1, 2), (2, 1)], [(1, 1)], [(1, 2), (2, 3), (3, 4), (4, 2)]])
def test_cycles_are_errors(spark, pairs):
    segments = spark.range(1, 5).withColumnRenamed("id", "comid")
    with pytest.raises(ValueError, match="cycle"):
        network.check_acyclic(segments, edge_table(spark, pairs))


def test_levels_and_summary(spark):
    segments = spark.range(1, 5).withColumnRenamed("id", "comid")
    got = network.levels(segments, network.powers(edge_table(spark, DIAMOND), 4)).orderBy("comid").collect()
    assert [r.topo_level for r in got] == [0, 1, 1, 2]
    assert network.summary(segments, edge_table(spark, Y)).first().asDict() == {"nodes": 4, "edges": 3, "sources": 2, "sinks": 1}
    with pytest.raises(ValueError, match="no segments"):
        network.validate(segments.limit(0), edge_table(spark, []))


def test_edges_of_a_comid_of_two_rows_count_once(spark):
    segments = spark.createDataFrame([(1,), (1,), (2,)], "comid long")
    assert network.summary(segments, edge_table(spark, [(1, 2)])).first().asDict() == {"nodes": 3, "edges": 1, "sources": 2, "sinks": 1}


def test_a_gap_is_no_observation(spark):
    closure = network.powers(edge_table(spark, CHAIN), 3)
    day = date(2010, 1, 1)
    flow = spark.createDataFrame([(day, 1, 1.0), (day, 2, 3.0), (day, 3, 7.0)], "date date, comid long, flow_cms double")
    obs = spark.createDataFrame([(day, "A", 2, 6.0), (day, "B", 1, float("nan"))], "date date, gage_id string, comid long, flow_cms double")
    reached = network.reach(obs.select("comid"), closure)
    got = folds.enforce_gages(obs, reached, flow).orderBy("comid").collect()
    assert [r.flow_cms for r in got] == [1.0, 6.0, 14.0]


def random_dag(seed, n=40):
    rng = random.Random(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(1, n + 1), rng.randrange(1, n + 1)) for _ in range(60)) if a != b})


@pytest.mark.parametrize("seed", [1, 2])
def test_random_networks(spark, seed):
    n, pairs = 40, random_dag(seed)
    rng = random.Random(seed)
    local = [rng.randrange(50) for _ in range(n)]
    q, level = dict(enumerate(map(float, local), 1)), dict.fromkeys(range(1, n + 1), 0)
    down = {i: [b for a, b in pairs if a == i] for i in q}
    for i in range(1, n + 1):  # edges go up in number, so this is a topological order
        for j in down[i]:
            q[j] += q[i]
            level[j] = max(level[j], level[i] + 1)
    closure = network.powers(edge_table(spark, pairs), n)
    assert as_list(network.accumulate(flow_table(spark, local), closure)) == list(q.values())
    segments = spark.range(1, n + 1).withColumnRenamed("id", "comid")
    assert {r.comid: r.topo_level for r in network.levels(segments, closure).collect()} == level
    expected = set()
    for s in (1, 5, 9):
        hops, front = {s: 0}, [s]
        while front:
            front = [j for i in front for j in down[i] if j not in hops and not hops.update({j: hops[i] + 1})]
        expected |= {(s, i, h) for i, h in hops.items()}
    sources = spark.createDataFrame([(1,), (5,), (9,)], "comid long")
    assert {tuple(r) for r in network.reach(sources, closure).collect()} == expected


def test_a_contracted_network_gives_what_paths_give(spark, monkeypatch):
    """A river, braids that lead past a segment, and a mesh; its tables are as large as the edges, however many pairs are far apart."""
    monkeypatch.setattr(network, "LAST", 40)
    pairs = sorted({(i, i + 1) for i in range(1, 60)} | {(i, i + 2) for i in range(3, 50, 9)} | {(60 + a, 60 + b) for a, b in random_dag(3)})
    n = max(b for _, b in pairs)
    closure = network.powers(edge_table(spark, pairs), n)
    assert closure.moves and closure.rest.count() <= 40
    assert sum(m.count() for m in closure.moves) + closure.rest.count() <= 1.5 * len(pairs)
    q, level = {i: float(i % 7) for i in range(1, n + 1)}, dict.fromkeys(range(1, n + 1), 0)
    for i, j in pairs:  # in order of the upper end
        q[j] += q[i]
        level[j] = max(level[j], level[i] + 1)
    assert as_list(network.accumulate(flow_table(spark, [i % 7 for i in range(1, n + 1)]), closure)) == list(q.values())
    segments = spark.range(1, n + 1).withColumnRenamed("id", "comid")
    assert {r.comid: r.topo_level for r in network.levels(segments, closure).collect()} == level
    with pytest.raises(ValueError, match="cycle"):
        network.powers(edge_table(spark, [*pairs, (30, 10)]), n)


def loss_case(spark, pairs, local, ends):
    links, n = edge_table(spark, pairs), len(local)
    steps = spark.createDataFrame([(k, up, ds, f) for k, (up, ds, f) in enumerate(ends)], "step long, up long, ds long, loss double")
    closure = network.powers(links, n)
    rows = control_points.paths(steps, links, closure)
    steps = steps.join(rows.select("step").distinct(), "step", "left_semi")
    flow = network.accumulate(flow_table(spark, local), closure)
    return as_list(folds.apply_losses(steps, control_points.members(rows), flow))


@pytest.mark.parametrize(
    ("pairs", "local", "ends", "expected"),
    [
        (CHAIN, (1, 2, 4), [(1, 3, 0.25)], (1, 3 * 0.75 / 7, 0.75)),
        (Y, (1, 2, 4, 8), [(1, 4, 0.0), (2, 4, 0.0)], (1, 2, 14 / 15, 2)),
        (Y, (1, 2, 4, 8), [(2, 4, 0.0), (1, 4, 0.0)], (1, 2, 7 / 15, 1)),
        (CHAIN, (1, 2, 4), [(2, 2, 0.5), (3, 1, 0.5)], (1, 3, 7)),
    ],
)
def test_losses(spark, pairs, local, ends, expected):
    assert loss_case(spark, pairs, local, ends) == pytest.approx(list(expected))


def test_random_losses_equal_a_plain_fold(spark):
    pairs = random_dag(7, 25)
    down = {i: sorted(b for a, b in pairs if a == i) for i in range(1, 26)}
    rng = random.Random(7)
    local = [rng.randrange(1, 9) for _ in range(25)]
    q = dict(enumerate(map(float, local), 1))
    for i in q:
        for j in down[i]:
            q[j] += q[i]
    ends = [(rng.randrange(1, 13), rng.randrange(12, 26), rng.choice([0.0, 0.1, 0.5])) for _ in range(14)]
    for up, ds, f in ends:
        hops, front = {up: 0}, [up]
        while front:
            front = [j for i in front for j in down[i] if j not in hops and not hops.update({j: hops[i] + 1})]
        if ds not in hops or up == ds:
            continue
        path = [ds]
        while path[-1] != up:
            path.append(min(i for i in hops if path[-1] in down[i] and hops[i] == hops[path[-1]] - 1))
        scale = q[up] * (1 - f) / q[ds] if q[ds] > 0 else 1.0
        for i in path[:-1]:
            q[i] *= scale
    assert loss_case(spark, pairs, local, ends) == pytest.approx(list(q.values()))


@pytest.mark.parametrize("most", [60, 150])
def test_one_river_in_turns(spark, monkeypatch, most):
    """One connected river whose steps cover each other: no turn is over the bound, and the flows are those of a plain loop to the last digit."""
    monkeypatch.setattr(folds, "FOLDED", most)
    rng = random.Random(most)
    q = {i: rng.uniform(0.1, 9.0) if i % 7 else 0.0 for i in range(60)}
    spans = [(k, *sorted(rng.sample(range(60), 2)), rng.choice([0.0, 0.25, 0.5])) for k in range(-20, 20)]
    rng.shuffle(spans)
    steps = spark.createDataFrame([(k, a, b, f) for k, a, b, f in spans], "step long, up long, ds long, loss double")
    members = spark.createDataFrame([(k, i) for k, a, b, _ in spans for i in range(a + 1, b + 1)], "step long, comid long")
    flow = spark.createDataFrame(list(q.items()), "comid long, q double")
    got = folds.apply_losses(steps, members, flow)
    for k, a, b, f in sorted(spans):
        scale = q[a] * (1 - f) / q[b] if q[b] > 0 else 1.0
        for i in range(a + 1, b + 1):
            q[i] *= scale
    assert {r.comid: r.q for r in got.collect()} == q
    ends = {i for _, a, b, _ in spans for i in (a, b)}
    weight = {k: 1 + sum(i in ends for i in range(a + 1, b + 1)) for k, a, b, _ in spans}
    hits = members.join(spark.createDataFrame([(i,) for i in ends], "comid long"), "comid", "left_semi")
    turned, turns = folds.loss_turns(steps, hits)
    turn = {r.step: r.turn for r in turned.collect()}
    assert sorted(turn) == sorted(weight) and [turn[k] for k in sorted(turn)] == sorted(turn.values()) and turns == max(turn.values()) + 1 > 1
    for t in range(turns):
        of = [weight[k] for k in sorted(turn) if turn[k] == t]
        assert sum(of[:-1]) < most + max(weight.values())


def test_rivers_are_folded_apart(spark):
    """Two rivers and a step that no other touches, with steps in mixed order."""
    pairs = [(1, 2), (2, 3), (11, 12), (12, 13), (21, 22)]
    flow = spark.createDataFrame([(i, float(i)) for i in (1, 2, 3, 11, 12, 13, 21, 22)], "comid long, q double")
    closure = network.powers(edge_table(spark, pairs), 8)
    steps = spark.createDataFrame([(0, 11, 13, 0.5), (1, 1, 3, 0.25), (2, 12, 13, 0.5), (3, 1, 2, 0.0), (4, 21, 22, 1.0)], "step long, up long, ds long, loss double")
    rows = control_points.paths(steps, edge_table(spark, pairs), closure)
    q = {i: float(i) for i in (1, 2, 3, 11, 12, 13, 21, 22)}
    for up, ds, loss, path in ((11, 13, 0.5, (12, 13)), (1, 3, 0.25, (2, 3)), (12, 13, 0.5, (13,)), (1, 2, 0.0, (2,)), (21, 22, 1.0, (22,))):
        scale = q[up] * (1 - loss) / q[ds]
        for i in path:
            q[i] *= scale
    got = {r.comid: r.q for r in folds.apply_losses(steps, control_points.members(rows), flow).collect()}
    assert got == q  # to the last digit


@pytest.mark.parametrize("sent", [0, 1_000_000])
@pytest.mark.parametrize(
    ("observed", "expected"),
    [([("A", 2, 6.0)], (1, 6, 14)), ([("A", 2, 6.0), ("B", 1, 3.0)], (3, 18, 42)), ([("A", 1, 0.0), ("B", 2, 5.0)], (0, 0, 0)), ([("A", 99, 5.0)], (1, 3, 7))],
)
def test_gages(spark, monkeypatch, sent, observed, expected):
    monkeypatch.setattr(folds, "SENT_PAIRS", sent)
    closure = network.powers(edge_table(spark, CHAIN), 3)
    flow = network.accumulate(flow_table(spark, (1, 2, 4)), closure)
    dates = spark.createDataFrame([(date(2010, 1, 1),), (date(2010, 2, 1),)], "date date")
    monthly = flow.crossJoin(dates).select("date", "comid", F.col("q").alias("flow_cms"))
    obs = spark.createDataFrame([(date(2010, 1, 1), g, c, v) for g, c, v in observed], "date date, gage_id string, comid long, flow_cms double")
    reached = network.reach(obs.select("comid").where("comid < 4"), closure)
    got = folds.enforce_gages(obs, reached, monthly).orderBy("date", "comid").collect()
    assert [r.flow_cms for r in got] == pytest.approx([*expected, 1, 3, 7])


@pytest.mark.parametrize("scales", [1, 7, 1_000_000])
def test_gages_of_many_months_against_a_plain_loop(spark, monkeypatch, scales):
    """Months without observations, gages seen twice in a month, gages on one segment: the same doubles."""
    monkeypatch.setattr(folds, "SENT_SCALES", scales)
    rng = random.Random(scales)
    pairs = [(i, i // 2) for i in range(2, 32)]
    closure = network.powers(edge_table(spark, pairs), 31)
    below = lambda c: {c} | (below(c // 2) if c > 1 else set())
    months = [date(2010, m, 1) for m in range(1, 7)]
    obs = [(m, f"G{c % 5}", c, round(rng.uniform(0, 9), 2)) for m in months[1:] for c in rng.sample(range(1, 32), 12)] + [(months[1], "G9", 40, 1.0)]
    obs += [(m, g, c, v + 0.5) for m, g, c, v in obs[:9]] + [(months[2], "A", 8, 0.0)]
    unit = {c: rng.uniform(1, 9) for c in range(1, 32)}
    flow = {(m, c): unit[c] * (i + 1) for i, m in enumerate(months) for c in unit}
    table = spark.createDataFrame([(m, c, q) for (m, c), q in flow.items()], "date date, comid long, flow_cms double")
    for m, g, c, v in sorted(obs):
        if c in unit:
            scale = 1.0 if flow[m, c] <= 0 else v / flow[m, c]
            for node in below(c):
                flow[m, node] *= scale
    observed = spark.createDataFrame(obs, "date date, gage_id string, comid long, flow_cms double")
    reached = network.reach(observed.select("comid").where("comid < 40"), closure)
    out = folds.enforce_gages(observed, reached, table)
    assert {(r.date, r.comid): r.flow_cms for r in out.collect()} == flow
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "date" in line.split("hashpartitioning", 1)[1] for line in plan.splitlines())


def test_no_row_of_a_month_and_segment_carries_the_months_scales(spark):
    """A month's scales are as many as gages: copied into each row they would be gages, months and segments multiplied."""
    closure = network.powers(edge_table(spark, CHAIN), 3)
    flow = spark.createDataFrame([(date(2010, m, 1), c, q) for m in (1, 2) for c, q in ((1, 1.0), (2, None), (3, 7.0))], "date date, comid long, flow_cms double")
    obs = spark.createDataFrame([(date(2010, 1, 1), "A", 1, 3.0)], "date date, gage_id string, comid long, flow_cms double")
    out = folds.enforce_gages(obs, network.reach(obs.select("comid"), closure), flow)
    assert sorted((r.date.month, r.comid, r.flow_cms) for r in out.collect() if r.comid != 2) == [(1, 1, 3.0), (1, 3, 21.0), (2, 1, 1.0), (2, 3, 7.0)]
    assert [r.flow_cms for r in out.where("comid = 2").collect()] == [None, None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("scales" in line for line in plan.splitlines())


def test_calibration(spark):
    best = 0.0001 + 4 * (0.0049 / 29)
    obs = spark.createDataFrame([(date(2010, 1, 1), "A", 1, best * 1e6 / 2592000)], "date date, gage_id string, comid long, flow_cms double")
    unit = flow_table(spark, (1.0,))
    dates = spark.createDataFrame([(date(2010, 1, 1),)], "date date")
    row = gages.best_coefficient(gages.calibration_table(obs, unit)).first()
    assert row.coeff == pytest.approx(0.0007758620689655172) and row.rmse == pytest.approx(0, abs=1e-9)
    assert gages.calibrate(obs, unit, dates, 1) == row.coeff
    for bad in (obs.limit(0), obs.withColumn("comid", F.lit(9).cast("long")), obs.withColumn("date", F.lit(date(2011, 1, 1)))):
        with pytest.raises(ValueError, match="gage|calibration"):
            gages.calibrate(bad, unit, dates, 1)
    two = obs.unionByName(obs.withColumn("flow_cms", F.lit(None).cast("double")))
    assert all(r.rmse != r.rmse for r in gages.calibration_table(two, unit).collect())
    for unknown in (two, obs.withColumn("flow_cms", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="unknown flows"):
            gages.calibrate(unknown, unit, dates, 1)


def test_the_calibrations_error_does_not_cancel(spark):
    """A good fit of large flows: sums of squares would lose the error."""
    coeff = 0.0001 + 4 * (0.0049 / 29)
    flows = [coeff * 1e6 * 1e6 * k / 2592000 + 1e-4 for k in range(1, 20)]
    obs = spark.createDataFrame([(date(2010, 1, 1), "A", k, v) for k, v in enumerate(flows, 1)], "date date, gage_id string, comid long, flow_cms double")
    row = gages.best_coefficient(gages.calibration_table(obs, flow_table(spark, [1e6 * k for k in range(1, 20)]))).first()
    assert row.rmse == pytest.approx(1e-4, rel=1e-3)


def test_local_area(spark):
    base = spark.createDataFrame([(1, 2.0, 9.0, None), (2, None, 9.0, 4.0)], "comid long, areasqkm double, totdasqkm double, lengthkm double")
    area = lambda df: [r.area_km2 for r in runoff.local_area(df).orderBy("comid").collect()]
    assert area(base) == [2.0, 0.0]
    assert area(base.withColumn("areasqkm", F.lit(None).cast("double"))) == [9.0, 9.0]
    assert area(base.select("comid", "lengthkm")) == [None, 8.0]
    with pytest.raises(KeyError):
        runoff.local_area(base.select("comid"))


def test_routed(spark):
    rows = [(1.4, "a", 1.0, 2.0, 9.0), (2.5, "b", 2.0, None, 8.0), (3.5, "c", 2.0, 3.0, 7.0), (None, "d", 3.0, 4.0, 6.0)]
    df = spark.createDataFrame(rows, "nhdplusid double, permanent_ string, fromnode double, tonode double, hydroseq double")
    assert sorted(r.comid for r in network.routed(df).collect()) == [1, 4]
    numbered = network.routed(df.drop("nhdplusid"))
    assert sorted((r.permanent_, r.comid) for r in numbered.collect()) == [("a", 1), ("c", 2), ("d", 3)]
    with pytest.raises(ValueError, match="occurs"):
        network.routed(df.withColumn("nhdplusid", F.lit(7.0)))
    with pytest.raises(KeyError):
        network.routed(df.drop("tonode"))
    with pytest.raises(KeyError):
        network.routed(df.drop("hydroseq"))
    with pytest.raises(ValueError, match="no routed"):
        network.routed(df.withColumn("tonode", F.lit(None).cast("double")))
    vaa = spark.createDataFrame([("a", 5.0, 6.0, 1.0)], "permanent_ string, fromnode double, tonode double, hydroseq double")
    assert [r.fromnode for r in network.routed(df.select("nhdplusid", "permanent_"), vaa).collect()] == [5.0]


@pytest.mark.parametrize(("leaf", "many"), [(1, 1), (1, 1000), (3, 1000), (64, 1000)])
def test_nearest(spark, monkeypatch, leaf, many):
    """Scattered and crowded sites, some in one place, queries among them and far away."""
    monkeypatch.setattr(nearest, "LEAF", leaf)
    monkeypatch.setattr(joins, "MANY", many)
    rng = random.Random(3)
    sites = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)]
    sites += [(100 + i, 50 + rng.uniform(0, 1e-3), 50 + rng.uniform(0, 1e-3)) for i in range(40)] + [(200 - i, 7.0, 7.0) for i in range(20)] + [(300, 90.0, 10.0), (301, 90.0, 12.0)]
    queries = [(f"q{i}", rng.uniform(-50, 400), rng.uniform(-50, 150)) for i in range(40)] + [(f"c{i}", 50 + rng.uniform(0, 1e-3), 50 + rng.uniform(0, 1e-3)) for i in range(30)]
    queries += [("tie", 90.0, 11.0), ("same", 7.0, 7.0), ("far", 1e9, -1e9)]
    rows = spark.createDataFrame(queries + [("none", None, 1.0), ("nan", float("nan"), 1.0)], "qid string, x double, y double")
    got = {r.qid: (r.comid, r.distance) for r in nearest.nearest(rows, spark.createDataFrame(sites + [(-1, None, 0.0)], "comid long, x double, y double")).collect()}
    want = {q: min((((s[1] - x) ** 2 + (s[2] - y) ** 2) ** 0.5, s[0]) for s in sites) for q, x, y in queries}
    assert got == {q: (c, d) for q, (d, c) in want.items()}


def test_nearest_where_a_pass_ends_with_its_first_level(spark):
    """Of 100 sites 80 lie in one quarter, whose own quarters hold no more than a leaf: its sites are found one level below it."""
    places = [(i, float(i % 9), float(i // 9)) for i in range(80)] + [(80 + i, 100.0 - i, 100.0) for i in range(20)]
    sites = spark.createDataFrame(places, "comid long, x double, y double")
    got = nearest.nearest(sites.selectExpr("comid as qid", "x + 0.25 as x", "y"), sites).collect()
    assert sorted((r.qid, r.comid, r.distance) for r in got) == [(i, i, 0.25) for i, _, _ in places]


def test_nearest_without_sites_or_extent(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0)], "qid string, x double, y double")
    none = spark.createDataFrame([], "comid long, x double, y double")
    assert nearest.nearest(rows, none).count() == 0 and nearest.nearest(rows.limit(0), none.unionAll(spark.sql("select 1L, 1D, 1D"))).count() == 0
    assert nearest.nearest(rows, spark.sql("select explode(array(5L, 4L)) as comid, 4D as x, 6D as y")).first().asDict() == {"qid": "a", "comid": 4, "distance": 5.0}


def test_a_control_point_without_a_place_is_an_error(spark):
    points = spark.createDataFrame([("A", "B", 0.1, 0, None, 0.0)], "UP_CP string, Next_DS_CP string, ChLosFac double, file_row long, x double, y double")
    with pytest.raises(ValueError, match="no place"):
        control_points.snap(points, spark.createDataFrame([(1, 10.0, 0.0)], "comid long, x double, y double"))


def test_snapping_and_keep_first(spark):
    points = spark.createDataFrame([("A", "B", 0.1, 0, 0.0, 0.0), ("B", None, 0.2, 1, 900.0, 0.0), ("A", "B", 0.3, 2, 500.0, 500.0), ("C", "Z", 0.0, 3, 1e7, 1e7)], "UP_CP string, Next_DS_CP string, ChLosFac double, file_row long, x double, y double")
    sites = spark.createDataFrame([(1, 10.0, 0.0), (2, 1000.0, 0.0), (3, -10.0, 0.0)], "comid long, x double, y double")
    got = {r.UP_CP: r for r in control_points.snap(points, sites).collect()}
    assert (got["A"].UP_COMID, got["A"].DS_COMID, got["A"].snap_dist, got["A"].ChLosFac) == (1, 2, 10.0, 0.1)
    assert got["B"].DS_COMID is None and got["C"].UP_COMID == 2 and got["C"].DS_COMID is None
    steps = control_points.pairs(control_points.snap(points, sites), sites).collect()
    assert [(r.step, r.up, r.ds) for r in steps] == [(0, 1, 2)]


class Written:
    """Tags and rows of the tables that `module` writes, and the scratch folders and shuffles that stay."""

    def __init__(self, spark, monkeypatch, module):
        self.spark, self.rows = spark, []
        plain = module.cut

        def cut(df, tag, *by):
            out = plain(df, tag, *by)
            self.rows.append((tag, out.count()))
            return out

        monkeypatch.setattr(module, "cut", cut)
        self.before = self.folders()

    def folders(self):
        files, at = scratch._at(self.spark, scratch.scratch_root(self.spark) + "/freshet")
        return {f.getPath().getName() for f in files.listStatus(at)} if files.exists(at) else set()

    def left(self):
        return sorted(name.rsplit("-", 1)[0] for name in self.folders() - self.before)


def shuffles(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


@pytest.mark.parametrize("last", [0, 200_000])
def test_reach_leaves_one_table_and_no_shuffles(spark, monkeypatch, last):
    monkeypatch.setattr(network, "LAST", last)
    closure = network.powers(edge_table(spark, [(i, i + 1) for i in range(1, 20)]), 20)
    written, before = Written(spark, monkeypatch, network), shuffles(spark)
    got = network.reach(spark.createDataFrame([(1,), (7,)], "comid long"), closure)
    assert written.left() == ["reach"] and shuffles(spark) <= before
    assert {tuple(r) for r in got.collect()} == {(s, c, c - s) for s in (1, 7) for c in range(s, 21)}


def test_paths_keep_no_more_of_the_tree_than_their_ends_need(spark, monkeypatch):
    links = edge_table(spark, [(i, i + 1) for i in range(1, 40)])
    closure = network.powers(links, 40)
    steps = spark.createDataFrame([(1, 1, 4, 0.1), (2, 2, 2, 0.1), (3, 30, 5, 0.1)], "step long, up long, ds long, loss double")
    written, before = Written(spark, monkeypatch, control_points), shuffles(spark)
    rows = control_points.paths(steps, links, closure)
    assert written.left() == ["cp-paths"] and shuffles(spark) <= before
    assert max(n for tag, n in written.rows if tag == "cp-parents") == 3
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4)]


def test_a_level_of_cells_has_not_as_many_as_sites(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 4)
    sites = spark.range(4096).selectExpr("id as comid", "cast(id div 64 as double) as x", "cast(id % 64 as double) as y")
    asked = spark.createDataFrame([("a", 3.2, 7.1), ("b", 60.0, 60.4)], "qid string, x double, y double")
    written = Written(spark, monkeypatch, nearest)
    found = nearest.nearest(asked, sites)
    assert written.left() == ["nearest"]
    assert sum(n for tag, n in written.rows if tag == "tree-levels") < 4096
    assert {(r.qid, r.comid) for r in found.collect()} == {("a", 3 * 64 + 7), ("b", 60 * 64 + 60)}


def test_losses_leave_their_scales_only(spark, monkeypatch):
    monkeypatch.setattr(folds, "FOLDED", 2)
    steps = spark.createDataFrame([(i, i, i + 1, 0.5) for i in range(1, 6)], "step long, up long, ds long, loss double")
    members = steps.selectExpr("step", "ds as comid")
    flow = flow_table(spark, [8, 8, 8, 8, 8, 8])
    written, before = Written(spark, monkeypatch, folds), shuffles(spark)
    out = folds.apply_losses(steps, members, flow)
    assert set(written.left()) == {"loss-scales"} and shuffles(spark) <= before
    assert as_list(out) == [8, 4, 2, 1, 0.5, 0.25]


@pytest.mark.parametrize("name", ["net_cycles", "net_topo_level", "flow_monthly", "flow_one_month_points", "calibrate_rmse", "calibrate_unknown", "reach_descendants", "cp_paths", "loss_apply"])
def test_a_query_leaves_its_result_only(spark, monkeypatch, name):
    written = Written(spark, monkeypatch, contract)
    contract.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert written.left() == {"net_cycles": [], "net_topo_level": ["levels"], "calibrate_unknown": ["flow", "unknown"], "reach_descendants": ["reach"], "cp_paths": ["path-rows"], "loss_apply": ["lost"]}.get(name, ["flow"])
