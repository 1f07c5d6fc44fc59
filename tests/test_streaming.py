"""Streams give the same tables however the files are split over batches and runs."""

import datetime as dt

from conftest import SEAT_PRICES_CSV, rows, write_files

from farescope.operators.views import seat_prices_latest
from farescope.schemas import SEAT_PRICES, STAMP_COLUMNS
from farescope.sources import store
from farescope.streaming import latest_table, pickup

COLUMNS = [*SEAT_PRICES.columns, *STAMP_COLUMNS]


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_pickup_loads_each_file_once(spark, tmp_path, snaps):
    folder, base = tmp_path / "in", str(tmp_path / "store")
    names = list(SEAT_PRICES_CSV)
    for part in (names[:1], [], names[1:], names):
        write_files(folder, {n: SEAT_PRICES_CSV[n] for n in part if not (folder / SEAT_PRICES_CSV[n][0]).exists()})
        run(pickup.start_pickup(spark, SEAT_PRICES, str(folder), base, str(tmp_path / "cp")))
    assert rows(store.read_table(spark, base, SEAT_PRICES), *COLUMNS) == rows(snaps, *COLUMNS)


def test_pickup_is_the_same_file_by_file_and_after_losing_its_checkpoint(spark, tmp_path, snaps):
    folder, base = tmp_path / "in", str(tmp_path / "store")
    write_files(folder, SEAT_PRICES_CSV)
    run(pickup.start_pickup(spark, SEAT_PRICES, str(folder), base, str(tmp_path / "cp1"), files_per_batch=1))
    run(pickup.start_pickup(spark, SEAT_PRICES, str(folder), base, str(tmp_path / "cp2")))
    assert rows(store.read_table(spark, base, SEAT_PRICES), *COLUMNS) == rows(snaps, *COLUMNS)


def silver_stream(spark, path):
    return (
        spark.readStream.schema(SEAT_PRICES.silver_schema).option("maxFilesPerTrigger", 1).parquet(path)
    )


def test_dedupe_within(spark, tmp_path, snaps):
    path, out = str(tmp_path / "silver"), str(tmp_path / "out")
    for _ in range(3):
        snaps.write.mode("append").parquet(path)
    stream = pickup.dedupe_within(silver_stream(spark, path), SEAT_PRICES, "30 days")
    run(
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(out)
    )
    assert rows(spark.read.parquet(out), *COLUMNS) == rows(snaps, *COLUMNS)


def test_start_dedupe_accepts_any_age(spark, tmp_path, snaps):
    path, base = str(tmp_path / "silver"), str(tmp_path / "store")
    for part in (snaps.orderBy(snaps.snapshot_ts.desc()).limit(2), snaps, snaps):
        part.write.mode("append").parquet(path)
    run(pickup.start_dedupe(silver_stream(spark, path), SEAT_PRICES, base, str(tmp_path / "cp")))
    assert rows(store.read_table(spark, base, SEAT_PRICES), *COLUMNS) == rows(snaps, *COLUMNS)


def test_latest_table_follows_the_stream(spark, tmp_path, snaps):
    path, out = str(tmp_path / "silver"), str(tmp_path / "latest")
    stamps = sorted({r.snapshot_ts for r in snaps.collect()})
    seen = []
    # The last stamp arrives before the middle one: late rows must not win.
    for stamp in (stamps[0], stamps[2], stamps[1]):
        seen.append(stamp)
        snaps.filter(snaps.snapshot_ts == stamp).write.mode("append").parquet(path)
        run(
            latest_table.start_latest_table(
                silver_stream(spark, path), SEAT_PRICES, out, str(tmp_path / "cp")
            )
        )
        want = seat_prices_latest(snaps.filter(snaps.snapshot_ts.isin(seen)))
        got = latest_table.read_latest(spark, out, SEAT_PRICES.silver_schema)
        assert rows(got, *COLUMNS) == rows(want, *COLUMNS)


def test_repeated_batch_changes_nothing(spark, tmp_path, snaps):
    out, keys = str(tmp_path / "latest"), latest_table.latest_keys(SEAT_PRICES)
    first = snaps.filter(snaps.snapshot_ts < dt.datetime(2025, 8, 1))
    for batch_id, batch in ((0, first), (1, snaps), (1, snaps)):
        latest_table.merge_batch(batch, batch_id, out, keys)
    got = latest_table.read_latest(spark, out, SEAT_PRICES.silver_schema)
    assert rows(got, *COLUMNS) == rows(seat_prices_latest(snaps), *COLUMNS)
    before = latest_table.read_latest(spark, out, SEAT_PRICES.silver_schema, before=1)
    assert rows(before, *COLUMNS) == rows(seat_prices_latest(first), *COLUMNS)


def test_superseded_batches_are_emptied(spark, tmp_path, snaps):
    out, keys = str(tmp_path / "latest"), latest_table.latest_keys(SEAT_PRICES)
    for batch_id in range(6):
        latest_table.merge_batch(snaps, batch_id, out, keys)
    on_disk = spark.read.schema(SEAT_PRICES.silver_schema).parquet(f"{out}/rows").count()
    live = latest_table.read_latest(spark, out, SEAT_PRICES.silver_schema)
    assert on_disk == 2 * live.count()
    assert rows(live, *COLUMNS) == rows(seat_prices_latest(snaps), *COLUMNS)


def test_one_row_into_a_large_week_writes_one_row(spark, tmp_path):
    """What a batch writes follows the batch; weeks are folded when their deltas have grown to their size."""
    schema = "date_of_journey date, schedule_id string, seat_type string, snapshot_ts timestamp_ntz, price int, week_start date"
    week, day = dt.date(2025, 8, 3), dt.date(2025, 8, 6)
    out, keys = str(tmp_path / "latest"), ["date_of_journey", "schedule_id", "seat_type"]

    def batch(batch_id, names, price, stamp):
        data = [(day, n, "A", dt.datetime(2025, 8, 1, stamp), price, week) for n in names]
        df = spark.createDataFrame(data, schema)
        latest_table.merge_batch(df, batch_id, out, keys, most_deltas=5)
        return df.schema

    def written(batch_id):
        return spark.read.parquet(f"{out}/rows/batch_id={batch_id}").count()

    shape = batch(0, [f"S{i}" for i in range(1000)], 1, 1)
    for n in range(1, 4):
        batch(n, [f"S{n}"], 10 + n, 2)
        assert written(n) == 1
    batch(4, ["S1", "new"], 99, 1)  # older than what S1 has
    assert written(4) == 2
    want = {f"S{i}": 1 for i in range(1000)} | {f"S{n}": 10 + n for n in range(1, 4)} | {"new": 99}
    latest = latest_table.read_latest(spark, out, shape)
    assert {r.schedule_id: r.price for r in latest.collect()} == want
    assert latest.count() == 1001
    batch(5, ["S9"], 50, 3)  # the fifth delta: folded
    assert written(5) == 1001
    assert {r.schedule_id: r.price for r in latest_table.read_latest(spark, out, shape).collect()} == want | {"S9": 50}
    before = latest_table.read_latest(spark, out, shape, before=5)
    assert {r.schedule_id: r.price for r in before.collect()} == want
    batch(5, ["S9"], 50, 3)  # repeated
    batch(6, ["S9"], 60, 4)
    assert written(6) == 1
    got = {r.schedule_id: r.price for r in latest_table.read_latest(spark, out, shape).collect()}
    assert got == want | {"S9": 60}


def test_dedupe_within_after_a_restart(spark, tmp_path):
    """The state outlives a run: a key inside the delay is dropped, one seen before that comes again."""
    path, out, cp = (str(tmp_path / n) for n in ("silver", "out", "cp"))
    fields = SEAT_PRICES.silver_schema

    def load(*seen):
        # The key has the stamp in it, so a repeat has the stamp of the first.
        data = [
            tuple({"schedule_id": s, "seat_type": "A", "date_of_journey": dt.date(2025, 8, 6), "snapshot_ts": t}.get(c) for c in fields.names)
            for s, t in seen
        ]
        spark.createDataFrame(data, fields).write.mode("append").parquet(path)
        run(pickup.start_dedupe_within(silver_stream(spark, path), SEAT_PRICES, "2 days", out, cp))
        return sorted((r.schedule_id, r.snapshot_ts.day) for r in spark.read.parquet(out).collect())

    day = [dt.datetime(2025, 8, d, 12) for d in range(1, 31)]
    assert load(("a", day[0]), ("a", day[0]), ("b", day[1])) == [("a", 1), ("b", 2)]
    # After the restart: both keys are remembered, a new one is taken.
    assert load(("a", day[0]), ("b", day[1]), ("c", day[2])) == [("a", 1), ("b", 2), ("c", 3)]
    assert load(("z", day[20])) == [("a", 1), ("b", 2), ("c", 3), ("z", 21)]
    # Older than the delay allows: dropped, known or not. A later one is taken.
    assert load(("late", day[5]), ("c", day[2]), ("y", day[20])) == [("a", 1), ("b", 2), ("c", 3), ("y", 21), ("z", 21)]
    state = spark.read.format("statestore").load(cp).count()
    assert state <= 2  # a, b and c are forgotten
