"""A replayed micro-batch rewrites its own partition; earlier keys are not re-inserted."""

import os

from hirelens.session import scratch_dir
from hirelens.streaming import ingest_stream


def _events(spark, rows):
    return ingest_stream.event_cards(spark.createDataFrame(rows, ingest_stream.EVENT_SCHEMA))


def test_upsert_is_idempotent(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    table = os.path.join(scratch_dir(), "t")
    up = ingest_stream.upsert_batch(table)
    b0 = _events(spark, [(1, t0, 7, "view", 1.5, '{"k": 1}'), (2, t0 + dt.timedelta(1), 7, "view", 9.0, '{"k": 2}')])
    b1 = _events(spark, [(3, t0 + dt.timedelta(2), 7, "view", 3.0, '{"k": 3}'),
                         (4, t0 + dt.timedelta(2), 8, "click", 4.0, '{"k": 4}')])
    up(b0, 0)
    up(b1, 1)
    up(b1, 1)                              # replay after a failure
    out = {(r.source, r.job_key): (float(r.salary_avg), r.batch_id)
           for r in spark.read.parquet(f"{table}/job").collect()}
    raw = {(r.source, r.job_key): (float(r.salary_text[:-1]), r.batch_id)
           for r in spark.read.parquet(f"{table}/raw_job").collect()}
    assert out == raw == {("view", "7"): (1.5, 0), ("click", "8"): (4.0, 1)}


def test_replay_of_a_first_batch_that_died(spark):
    import datetime as dt
    table = os.path.join(scratch_dir(), "t")
    for name in ingest_stream.TARGETS:
        os.makedirs(os.path.join(table, name, "batch_id=0", "_temporary"))
    ingest_stream.upsert_batch(table)(_events(spark, [(1, dt.datetime(2024, 1, 1), 7, "view", 1.5, None)]), 0)
    assert all(spark.read.parquet(f"{table}/{name}").count() == 1 for name in ingest_stream.TARGETS)


def test_replay_of_a_batch_that_died_between_the_tables(spark):
    import datetime as dt
    import shutil
    table = os.path.join(scratch_dir(), "t")
    up = ingest_stream.upsert_batch(table)
    t0 = dt.datetime(2024, 1, 1)
    up(_events(spark, [(1, t0, 7, "view", 1.5, None)]), 0)
    b1 = _events(spark, [(2, t0, None, "view", 2.5, None), (3, t0, 7, "view", 3.5, None)])
    up(b1, 1)
    shutil.rmtree(os.path.join(table, "job", "batch_id=1"))
    up(b1, 1)
    for name in ingest_stream.TARGETS:
        rows = spark.read.parquet(f"{table}/{name}").collect()
        # an event without a user has the key derived from its card
        assert sorted(r.job_key[0] for r in rows) == ["7", "h"] and {r.batch_id for r in rows} == {0, 1}


def test_landing_over_two_months_in_order(spark):
    import datetime as dt
    base = scratch_dir()
    rows = [(i, dt.datetime(2024, 1, 25) + dt.timedelta(days=i) if i else None, 7, "view", float(i), None) for i in range(20)]
    spark.createDataFrame(rows, ingest_stream.EVENT_SCHEMA).write.parquet(os.path.join(base, "events.parquet"))
    landing = os.path.join(base, "landing")
    ingest_stream.land_events(spark, base, landing, parts=4)
    files = sorted((os.path.getmtime(os.path.join(landing, f)), f) for f in os.listdir(landing) if f.endswith(".parquet"))
    ids = [sorted(r.event_id for r in spark.read.parquet(os.path.join(landing, f)).collect()) for _, f in files]
    flat = [x for part in ids for x in part]
    assert sorted(flat) == list(range(20)) and flat[0] == 0 and flat == sorted(flat)


def _land(spark, landing, files):
    """One landing file per list of events, in this order of arrival."""
    import time
    for rows in files:
        spark.createDataFrame(rows, ingest_stream.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)


def _stream_files():
    import datetime as dt
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    return [[(5, t[1], 7, "view", 5.0, None), (1, t[0], 7, "view", 1.5, None), (2, None, 9, "buy", 2.0, None),
             (3, t[0], 9, "buy", 3.0, None)],
            [(4, t[0], 7, "view", 0.5, None), (6, t[2], 8, "click", 4.0, None), (7, t[2], None, "click", 6.0, None)],
            [(8, t[3], 8, "click", 8.0, None), (9, t[4], 10, None, 9.0, None)]]


WANT = {("view", "7"): (1.5, 0), ("buy", "9"): (2.0, 0), ("click", "8"): (4.0, 1), ("unknown", "10"): (9.0, 2)}


def _held(tables):
    found = {}
    for name, t in tables.items():
        value = "salary_avg" if name == "job" else "regexp_replace(salary_text, 'K', '')"
        found[name] = {(r.source, r.job_key): (float(r.v), r.batch_id) for r in
                       t.selectExpr("source", "job_key", f"{value} AS v", "batch_id").collect()}
    return found


def test_keyed_state_remembers_earlier_batches(spark):
    base = scratch_dir()
    _land(spark, f"{base}/landing", _stream_files())
    got = _held(ingest_stream.run_ingest_stream(spark, f"{base}/landing", f"{base}/t", f"{base}/c"))
    for rows in got.values():
        derived = [k for k in rows if k[0] == "click" and k[1] != "8"]     # an event without a user has its own key
        assert len(derived) == 1 and rows.pop(derived[0]) == (6.0, 1)
        assert rows == WANT


def test_a_batch_that_died_between_the_tables_is_replayed(spark):
    import pytest
    base = scratch_dir()
    _land(spark, f"{base}/landing", _stream_files())

    def dies_in_batch_1(path):
        whole = ingest_stream.write_batch(path)

        def run(batch, batch_id):
            if batch_id == 1:
                ingest_stream.bronze_from_raw(batch).write.mode("overwrite").parquet(f"{path}/raw_job/batch_id=1")
                raise OSError("lost")
            whole(batch, batch_id)
        return run
    paths = f"{base}/landing", f"{base}/t", f"{base}/c"
    with pytest.raises(Exception, match="lost"):
        ingest_stream.run_ingest_stream(spark, *paths, write=dies_in_batch_1)
    got = _held(ingest_stream.run_ingest_stream(spark, *paths))
    assert {k: v for k, v in got["job"].items() if k in WANT} == WANT
    assert {k: v for k, v in got["raw_job"].items()} == got["job"]


def test_a_batch_reads_nothing_of_the_tables(spark):
    base = scratch_dir()
    files = _stream_files()
    _land(spark, f"{base}/landing", files[:1])
    paths = f"{base}/landing", f"{base}/t", f"{base}/c"
    ingest_stream.run_ingest_stream(spark, *paths)
    import shutil
    shutil.rmtree(f"{base}/t")                  # the state alone says what was written
    _land(spark, f"{base}/landing", files[1:2])
    got = _held(ingest_stream.run_ingest_stream(spark, *paths))
    assert ("view", "7") not in got["job"] and got["job"]["click", "8"] == (4.0, 1)
