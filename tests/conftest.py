import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("farescope-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SEAT_PRICES_CSV = {
    "31-08": (
        "seat_prices_2025-07-31_08-00.csv",
        [
            "schedule_id,seat_type,hours_before_departure,actual_fare,price,actual_occupancy,"
            "expected_occupancy,demand_index,operator_id,date_of_journey",
            "S1,A,10,100,90,50,60,M/L,191,2025-08-06",
            "S1,B,10,,80,,60,,191,2025-08-06",
        ],
    ),
    "05-08": (
        "seat_prices_2025-08-05_08-00.csv",
        [
            "schedule_id,seat_type,hours_before_departure,actual_fare,price,actual_occupancy,"
            "expected_occupancy,demand_index,operator_id,date_of_journey",
            "S1,A,2,120,125,70,75,0.8,191,2025-08-06",
            "S1,A,2,120,125,70,75,0.8,191,2025-08-06",
            "S1,B,2,60,,40,40,1,191,2025-08-06",
        ],
    ),
    "06-08": (
        "seat_prices_2025-08-06_08-00.csv",
        [
            " Date_Of_Journey ,OPERATOR_ID,schedule_id,junk,seat_type,hours_before_departure,"
            "actual_fare,price,actual_occupancy,expected_occupancy,demand_index",
            "2025-08-06,191,S1,zz,B,0,abc,70,41,42,H",
        ],
    ),
}

SEAT_WISE_CSV = {
    "31-08": (
        "seat_wise_prices_2025-07-31_08-00.csv",
        ["schedule_id,seat_number,seat_type,final_price,actual_fare,travel_date",
         "S1,1,A,90,100,2025-08-06"],
    ),
    "05-08": (
        "seat_wise_prices_2025-08-05_08-00.csv",
        ["schedule_id,seat_number,seat_type,final_price,actual_fare,travel_date",
         "S1,1,A,125,120,2025-08-06",
         "S1,2,A,130,120,2025-08-06",
         "S1,10,B,55,60,2025-08-06"],
    ),
}


def write_files(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, lines in files.values():
        (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture(scope="session")
def feed_folders(tmp_path_factory):
    base = tmp_path_factory.mktemp("feed files")
    return {
        "seat_prices": write_files(base / "seat_prices", SEAT_PRICES_CSV),
        "seat_wise_prices": write_files(base / "seat_wise_prices", SEAT_WISE_CSV),
    }


@pytest.fixture(scope="session")
def store_base(spark, feed_folders, tmp_path_factory):
    from farescope.sources import store

    base = str(tmp_path_factory.mktemp("store"))
    counts = store.load_all(spark, feed_folders, base)
    assert counts == {"seat_prices": 5, "seat_wise_prices": 4}
    return base


@pytest.fixture(scope="session")
def snaps(spark, store_base):
    from farescope.schemas import SEAT_PRICES
    from farescope.sources import store

    return store.read_table(spark, store_base, SEAT_PRICES)


@pytest.fixture(scope="session")
def seats(spark, store_base):
    from farescope.schemas import SEAT_WISE_PRICES
    from farescope.sources import store

    return store.read_table(spark, store_base, SEAT_WISE_PRICES)


def rows(df, *columns):
    df = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
