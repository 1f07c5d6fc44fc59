"""One key holds a third or more of all rows: results stay whole, plans stay split."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from farescope.operators import choices, filters, lookups, rollups, trends
from farescope.operators.joins import rows_not_in
from farescope.operators.latest import first_per_key, latest_all, latest_one, number_in_group, number_in_order

BASE = dt.datetime(2025, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def history(spark):
    """20 000 snapshots; schedule 0 has over a third, with many equal stamps."""
    rng = random.Random(7)
    data = []
    for i in range(20_000):
        schedule = "0" if rng.random() < 0.4 else str(rng.randrange(1, 300))
        data.append(
            (
                schedule,
                rng.choice("AB"),
                float(rng.randrange(0, 400)) / 4,
                BASE + dt.timedelta(hours=rng.randrange(200)),
                rng.randrange(100),
                rng.randrange(100),
                i,
            )
        )
    df = spark.createDataFrame(
        data,
        "schedule_id string, seat_type string, hours_before_departure double, snapshot_ts timestamp_ntz,"
        " actual_fare int, price int, n int",
    ).withColumn("date_of_journey", F.lit(BASE.date()))
    return df.repartition(4).persist(), data


def test_latest_all_keeps_every_tie(history):
    df, data = history
    best = defaultdict(lambda: BASE)
    for s, t, _, ts, *_ in data:
        best[s, t] = max(best[s, t], ts)
    want = sorted(r[6] for r in data if best[r[0], r[1]] == r[3])
    got = latest_all(df, ["schedule_id", "seat_type"])
    assert sorted(r.n for r in got.collect()) == want
    # No window over the key: rows come back by a join, which AQE can split.
    assert "Window" not in plan_of(got)


def test_latest_one_is_reduced_before_the_shuffle(history):
    df, data = history
    best = {}
    for s, t, _, ts, _, _, n in data:
        best[s, t] = max(best.get((s, t), (BASE, 1)), (ts, -n))
    got = latest_one(df, ["schedule_id", "seat_type"], ties=["n"])
    assert {(r.schedule_id, r.seat_type): r.n for r in got.collect()} == {k: -v[1] for k, v in best.items()}
    plan = plan_of(got)
    shuffle = plan.index("Exchange hashpartitioning(schedule_id")
    assert "Partial" in plan[shuffle:]
    assert "WindowGroupLimit" in plan[shuffle:]


def test_sums_are_combined_before_the_choice(history):
    df, _ = history
    plan = plan_of(rollups.monthly_delta_schedule(df))
    assert "partial_sum" in plan
    assert "WindowGroupLimit" in plan


def test_nearest_requests_against_brute_force(spark, history):
    df, data = history
    rng = random.Random(3)
    asked = sorted(
        {(str(rng.randrange(0, 320)), round(rng.uniform(-60, 400), 2)) for _ in range(800)}
        | {("0", round(rng.uniform(0, 101), 3)) for _ in range(800)}
        | {("0", 24.0), ("0", 23.995), ("0", 24.005), ("0", 47.9951), ("1", 1000.0)}
    )
    known = defaultdict(dict)
    for s, _, h, ts, *_ in data:
        known[s][h] = max(known[s].get(h, BASE), ts)

    def nearest(s, x):
        def rank(item):
            gap = abs(item[0] - x)
            return (0 if gap < 0.01 else -gap, item[1])

        return max(known[s].items(), key=rank)

    want = [(s, x, *nearest(s, x)) for s, x in asked if s in known]
    requests = spark.createDataFrame(asked, "schedule_id string, requested_hours double")
    got = rows(lookups.nearest_snapshots_for(df, requests))
    assert sorted(got) == sorted(want)
    by_list = lookups.nearest_snapshots(df, [24.0, 47.9951])
    assert ("0", 24.0, *nearest("0", 24.0)) in rows(by_list)
    plan = plan_of(lookups.nearest_snapshots_for(df, requests))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_exact_hour_prefers_the_later_stamp_within_tolerance(spark):
    data = [("S", 24.0, BASE), ("S", 24.005, BASE + dt.timedelta(1)), ("S", 23.999, BASE + dt.timedelta(2))]
    df = spark.createDataFrame(data, "schedule_id string, hours_before_departure double, snapshot_ts timestamp_ntz")
    requests = spark.createDataFrame(
        [("S", 24.0), ("S", 24.008), ("S", 23.99)], "schedule_id string, requested_hours double"
    )
    want = [("S", 23.99, 23.999, data[2][2]), ("S", 24.0, 23.999, data[2][2]), ("S", 24.008, 23.999, data[2][2])]
    assert sorted(rows(lookups.nearest_snapshots_for(df, requests))) == want
    assert sorted(rows(lookups.nearest_snapshots(df, [23.99, 24.0, 24.008]))) == want


def test_number_in_group_counts_across_blocks(spark):
    wide = [n * n * n * 1000 for n in range(-300, 900)]
    numbers = [("hot", n) for n in range(-3000, 9000, 3)] + [("wide", n) for n in wide]
    numbers += [("cold", n) for n in (5, 1023, 1024, 90_000)]
    df = spark.createDataFrame(numbers, "k string, n bigint").repartition(4)
    got = {(r.k, r.n): r.position for r in number_in_group(df, ["k"], "n", "position").collect()}
    want = {}
    for key in ("hot", "wide", "cold"):
        for i, n in enumerate(sorted(n for k, n in numbers if k == key)):
            want[key, n] = i
    assert got == want


def test_number_in_order_spreads_a_hot_key_and_ties(spark):
    rng = random.Random(5)
    data = [("hot" if i % 2 else rng.choice("abc"), rng.choice((None, 1.5, *map(float, range(60)))), i) for i in range(8000)]
    data += [(None, 3.0, i) for i in range(9000, 9100)]
    data += [("hot", 7.0, -1)] * 4000  # rows that are equal in every column
    df = spark.createDataFrame(data, "k string, v double, i int").repartition(6)
    order = [F.col("v").desc_nulls_last(), F.col("i")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = number_in_order(df, ["k"], order, "place")
        got = sorted((str(r.k), r.place, r.v, r.i) for r in placed.collect())
        # The ranges that the written table has, and the most rows of one.
        ranges = placed.inputFiles()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want, at = [], defaultdict(int)
    for k, v, i in sorted(data, key=lambda r: (str(r[0]), r[1] is None, -(r[1] or 0), r[2])):
        at[k] += 1
        want.append((str(k), at[k], v, i))
    assert sorted(want, key=repr) == sorted(got, key=repr)
    most = max(spark.read.parquet(f).count() for f in ranges)
    assert most < len(data) / 3  # "hot" has two thirds, its equal rows a third
    whole = number_in_order(df, [], [F.col("i")], "place").agg(F.min("place"), F.max("place"), F.countDistinct("place"))
    assert rows(whole) == [(1, len(data), len(data))]
    assert number_in_order(df.limit(0), ["k"], order, "place").count() == 0


def test_lists_of_a_hot_schedule(history):
    df, data = history
    hours = defaultdict(set)
    for s, _, h, *_ in data:
        hours[s].add(h)
    want = {(s, h, i) for s, hs in hours.items() for i, h in enumerate(sorted(hs, reverse=True), 1)}
    listed = choices.listed_hours(df)
    assert {(r.schedule_id, r.hours_before_departure, r.position) for r in listed.collect()} == want
    shown = trends.in_display_order(df.select("schedule_id", "seat_type", "hours_before_departure", "n"))
    places = defaultdict(list)
    for r in shown.collect():
        places[r.schedule_id].append((r.position, r.seat_type, -r.hours_before_departure))
    for rows_of in places.values():
        rows_of.sort()
        assert [p for p, *_ in rows_of] == list(range(1, len(rows_of) + 1))
        assert [r[1:] for r in rows_of] == sorted(r[1:] for r in rows_of)


def test_price_sum_equals_sum_over_seats(spark):
    rng = random.Random(1)
    seat_rows, snap_rows = [], set()
    for _ in range(6000):
        schedule = "0" if rng.random() < 0.5 else str(rng.randrange(1, 40))
        ts = BASE + dt.timedelta(hours=rng.randrange(30))
        seat_type = rng.choice("AB")
        seat_rows.append((schedule, str(rng.randrange(40)), seat_type, ts, rng.randrange(100), rng.randrange(100)))
        snap_rows.add((schedule, seat_type, float(rng.randrange(6)), ts))
    seats = spark.createDataFrame(
        seat_rows,
        "schedule_id string, seat_number string, seat_type string, snapshot_ts timestamp_ntz,"
        " actual_fare int, final_price int",
    )
    snaps = spark.createDataFrame(
        sorted(snap_rows),
        "schedule_id string, seat_type string, hours_before_departure double, snapshot_ts timestamp_ntz",
    )
    newest = {}
    for s, t, h, ts in snap_rows:
        newest[s, t, h] = max(newest.get((s, t, h), BASE), ts)
    first = {}
    for s, n, t, ts, a, f in seat_rows:
        key = (s, t, ts, n)
        first[key] = min(first.get(key, (a, f)), (a, f))
    want = defaultdict(lambda: [0, 0, 0])
    at = defaultdict(list)
    for (s, t, ts, _), prices in first.items():
        at[s, t, ts].append(prices)
    for (s, t, h), ts in newest.items():
        for a, f in at[s, t, ts]:
            cell = want[s, t, h]
            cell[0] += a
            cell[1] += f
            cell[2] += 1
    got = trends.price_sum_by_hour(seats, snaps, ties=("actual_fare", "final_price"))
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == dict(want)


@pytest.fixture
def splitting(spark):
    """Thresholds so low that AQE treats the hot key of ``history`` as skewed."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_keys_are_split_in_joins(spark, history, splitting):
    df, data = history
    parts = [(str(i), f"name {i}") for i in range(300)]
    names = spark.createDataFrame(parts, "id string, name string")
    half = df.filter("schedule_id <> '0' AND n % 2 = 0")
    cases = {
        "latest_all": (latest_all(df, ["schedule_id"], "date_of_journey"), 20_000),
        "with_name": (choices.with_name(df, names, "schedule_id", "id", "name", "label"), 20_000),
        "of_schedules": (filters.of_schedules(df, df), 20_000),
        "not_in": (rows_not_in(df, half, ["schedule_id"]), None),
    }
    for name, (result, count) in cases.items():
        run = result.select("n", "actual_fare", "price", "snapshot_ts")
        got = run.collect()
        assert "skew=true" in plan_of(run), name
        assert count in (None, len(got)), name
    gone = {r[0] for r in data if r[0] != "0" and r[6] % 2 == 0}
    assert cases["not_in"][0].count() == sum(r[0] not in gone for r in data)


def test_first_per_key_orders_nulls_last(spark):
    df = spark.createDataFrame([("a", None), ("a", BASE)], "k string, snapshot_ts timestamp_ntz")
    got = first_per_key(df, ["k"], [F.col("snapshot_ts").desc_nulls_last()])
    assert rows(got) == [("a", BASE)]


def test_no_query_pairs_rows_without_a_key(spark):
    from conftest import SMALL

    from farescope.plans.registry import QUERIES

    for name, query in QUERIES.items():
        plan = plan_of(query(spark, SMALL))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


@pytest.mark.parametrize(
    "name, scans",
    [
        ("latest_seat_type", 1), ("latest_seat", 2), ("operator_compare_seat_type", 2), ("operator_compare_stats", 2),
        ("operator_compare_seat", 4), ("operator_compare_seat_stats", 4), ("seat_rows_13", 4),
    ],
)
def test_scans_of_a_query(spark, name, scans):
    """``seat`` and ``trip`` scan two tables each."""
    from conftest import SMALL

    from farescope.plans.registry import QUERIES

    assert plan_of(QUERIES[name](spark, SMALL)).count("FileScan parquet") <= scans
