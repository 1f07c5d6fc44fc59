"""What a load costs a record, and what it reads of the table."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from farescope.plans.session import setting
from farescope.schemas import SEAT_PRICES, SEAT_WISE_PRICES
from farescope.sources import feeds, store

DAY, STAMP = dt.date(2025, 8, 6), dt.datetime(2025, 8, 1, 8)
KEYS = "schedule_id string, seat_type string, date_of_journey date, snapshot_ts timestamp_ntz"


def test_cells_of_plain_records_are_those_of_the_csv_parser(spark):
    texts = ["a,b,c", ",,", " a , ,b", "a\\,b", "None,NaN,\ta", "é,#N/A,x'y", '"a,b",c', '"say ""x""",,', 'x"y,z']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    names = [f"c{i}" for i in range(3)]
    want = F.from_csv("value", ", ".join(f"{n} string" for n in names), feeds.CSV)
    got = df.select(feeds._cells(F.col("value"), 3).alias("x"), want.alias("y")).collect()
    for r in got:
        x = [c or None for c in r.x]  # an empty cell is a missing one
        assert x + [None] * (3 - len(x)) == [r.y[n] for n in names]


def test_the_parsing_of_records_is_compiled(spark, tmp_path, capsys):
    """The JVM does not compile functions above 8000 bytes; the CSV parser is asked only for records with quotes."""
    path = tmp_path / "seat_prices_2025-08-01_08-00.csv"
    path.write_text("schedule_id,seat_type,price\nS1,A,5\n")
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        raw = feeds.read_feed(spark, SEAT_PRICES, [str(path)])
        raw.explain("codegen")
        sizes = [int(x.split(";")[0]) for x in capsys.readouterr().out.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000
    record = [x for x in raw._jdf.queryExecution().optimizedPlan().toString().splitlines() if "split(value" in x]
    assert len(record) == 1 and record[0].count("from_csv") == 1 and record[0].index("split(") < record[0].index("from_csv")


def test_a_header_below_the_first_line_is_found(spark, tmp_path):
    texts = {"06-30": "junk\n\nschedule_id,seat_type\nS1,A\n", "07-30": "seat_type,schedule_id\nB,S2\n", "08-30": "x\ny\n"}
    paths = [tmp_path / f"seat_wise_prices_2025-01-01_{k}.csv" for k in texts]
    for path, text in zip(paths, texts.values(), strict=True):
        path.write_text(text)
    lines = feeds.land(feeds.read_lines(spark, [str(p) for p in paths]))
    raw, notes = feeds.parse_lines(lines, SEAT_WISE_PRICES)
    assert rows(raw, "schedule_id", "seat_type") == [("S1", "A"), ("S2", "B")]
    assert sorted(r.has_header for r in notes.collect()) == [False, True, True]
    typed = feeds.typed(raw, SEAT_WISE_PRICES)
    again = feeds.typed(raw.drop(*feeds.STAMPS), SEAT_WISE_PRICES)
    assert rows(typed) == rows(again)
    assert rows(typed, "snapshot_time") == [("06:30:00",), ("07:30:00",)]


def test_a_load_reads_the_table_near_its_keys(spark, tmp_path):
    stamps = [STAMP + dt.timedelta(hours=h) for h in range(10)]
    table = spark.createDataFrame([(f"S{i}", "A", DAY, t) for t in stamps for i in range(20)], KEYS)
    base = str(tmp_path / "store")
    store.append(store.conform(table, SEAT_PRICES), base, SEAT_PRICES)
    held = store.read_table(spark, base, SEAT_PRICES)
    key = SEAT_PRICES.primary_key

    def near(*keys):
        new = store.conform(spark.createDataFrame(list(keys), KEYS), SEAT_PRICES)
        return new, store.only_keys_near(held, new, key)

    new, target = near(("S3", "A", DAY, stamps[4]), ("S5", "A", DAY, stamps[4]), ("S1", None, DAY, stamps[0]))
    scan = target._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert "snapshot_ts" in scan and "schedule_id" in scan
    assert rows(target, "schedule_id", "snapshot_ts") == [(f"S{i}", stamps[4]) for i in (3, 4, 5)]
    assert store.insert_ignore(new, base, SEAT_PRICES) == 0
    assert near(("S1", None, DAY, stamps[0]))[1].count() == 0
    late, _ = near(("S3", "A", DAY, stamps[4]), ("S3", "B", DAY, stamps[4] + dt.timedelta(microseconds=1)))
    assert store.insert_ignore(late, base, SEAT_PRICES) == 1
    assert store.insert_ignore(late, base, SEAT_PRICES) == 0
