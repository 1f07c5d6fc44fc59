from conftest import SMALL

from farescope.plans import proxies, session

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
FORCE = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def test_tune_keeps_the_callers_values(spark):
    before = spark.conf.get(FORCE, None)
    spark.conf.set(FORCE, "false")
    session.tune(spark)
    assert spark.conf.get(FORCE) == "false"
    spark.conf.unset(FORCE)
    session.tune(spark)
    assert spark.conf.get(FORCE) == "true"
    if before is not None:
        spark.conf.set(FORCE, before)


def test_shuffles_follow_the_input_size(spark, monkeypatch):
    events = proxies.table(spark, SMALL, "events")
    own = spark.conf.get(INITIAL, None)
    try:
        monkeypatch.setattr(session, "BYTES_PER_SHUFFLE_PARTITION", 1 << 20)
        session.size_shuffles(events)
        assert int(spark.conf.get(INITIAL)) >= 100
        monkeypatch.setattr(session, "BYTES_PER_SHUFFLE_PARTITION", 1 << 30)
        session.size_shuffles(events)
        assert spark.conf.get(INITIAL) == spark.conf.get(session.DEFAULT)
    finally:
        spark.conf.set(INITIAL, own) if own else spark.conf.unset(INITIAL)


def test_size_settings():
    assert [session._bytes(x) for x in ("1024", "134217728b", "16m", "128MB", "1g")] == [1024, 1 << 27, 1 << 24, 1 << 27, 1 << 30]


def test_working_folders_lie_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = session.working_folder(spark, "x"), session.working_folder(spark, "x")
    assert a != b
    assert a.startswith(f"{base}/x-")


def test_tables_are_read_in_fine_splits(spark):
    keys = (*session.FINE, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in session.FINE:
            spark.conf.unset(k)
        proxies.table(spark, SMALL, "events")
        assert {k: spark.conf.get(k) for k in session.FINE} == session.FINE
        with session.setting(spark, session.ADVISORY, session.FILE_BYTES):
            assert spark.conf.get(session.ADVISORY) == "64m"
        assert spark.conf.get(session.ADVISORY) == "16m"
        spark.conf.set(session.ADVISORY, "5m")
        proxies.table(spark, SMALL, "events")
        assert spark.conf.get(session.ADVISORY) == "5m"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
