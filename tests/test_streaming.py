from datetime import datetime, timedelta

from evograph.streaming import watch

T0 = datetime(2025, 1, 1)
ROWS = [(i, T0 + timedelta(hours=h), u, e, v, None) for i, (h, u, e, v) in enumerate([(0, 1, "view", 1.0), (1, 1, "click", 4.0), (30, 1, "view", 2.0), (0, 2, "view", 5.0), (24, 2, "view", 5.5), (48, 2, "click", 5.0), (120, 2, "view", 1.0)])]


def events(spark, tmp_path, rows=ROWS, parts=1):
    for p in range(parts):
        spark.createDataFrame(rows[p::parts] if parts > 1 else rows, watch.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return watch.file_events(watch.watch_source(spark, str(tmp_path / "in"), files_per_trigger=1))


def test_deltas_go_on_over_batches(spark, tmp_path):
    first, later = [r for r in ROWS if r[1] < T0 + timedelta(hours=20)], [r for r in ROWS if r[1] >= T0 + timedelta(hours=20)]
    for rows in (first, later):
        watch.run_to_end(watch.deltas(events(spark, tmp_path, rows)), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.event_id, r.kind, r.delta) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "added", 1.0), (1, "modified", 3.0), (2, "modified", -2.0), (3, "added", 5.0), (4, "modified", 0.5), (5, "modified", -0.5), (6, "modified", -4.0)}


def test_debounce_closes_bursts_behind_the_watermark(spark, tmp_path):
    late = [(99, T0 + timedelta(days=30), 9, "end", 0.0, None)]
    events(spark, tmp_path, ROWS)
    stream = watch.debounce(events(spark, tmp_path, late), "6 hours")
    watch.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.key, r.event_id, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    static = watch.debounce(watch.file_events(spark.createDataFrame(ROWS, watch.SCHEMA)), "6 hours").collect()
    assert got == {(r.key, r.event_id, r.events) for r in static} == {(1, 1, 2), (1, 2, 1), (2, 3, 1), (2, 4, 1), (2, 5, 1), (2, 6, 1)}


def test_totals_and_streaks(spark, tmp_path):
    stream = events(spark, tmp_path)
    watch.run_to_end(watch.totals(stream), str(tmp_path / "t"), str(tmp_path / "tc"), "update")
    assert {(r.event_type, r.events) for r in spark.read.parquet(str(tmp_path / "t/*")).collect()} == {("view", 5), ("click", 2)}
    watch.run_to_end(watch.activity_streaks(stream), str(tmp_path / "s"), str(tmp_path / "sc"), "update")
    got = {r.key: (r.current, r.longest, r.days) for r in spark.read.parquet(str(tmp_path / "s/*")).collect()}
    assert got == {1: (2, 2, 2), 2: (1, 3, 4)}


def test_bursts_are_half_a_second_apart(spark):
    ms = lambda i, x: (i, T0 + timedelta(milliseconds=x), 1, "view", 1.0, None)
    df = watch.file_events(spark.createDataFrame([ms(0, 0), ms(1, 499), ms(2, 998), ms(3, 1499), ms(4, 1900)], watch.SCHEMA))
    assert sorted((r.event_id, r.events) for r in watch.debounce(df).collect()) == [(2, 3), (4, 2)]


def test_deleted_files_begin_anew(spark, tmp_path):
    h = lambda i, n, u, v: (i, T0 + timedelta(hours=n), u, "x", v, None)
    for rows in ([h(0, 0, 1, 3.0), h(1, 1, 1, None), h(2, 2, 2, None)], [h(3, 3, 1, 5.0), h(4, 4, 1, 4.0), h(5, 5, None, 1.0)]):
        watch.run_to_end(watch.deltas(events(spark, tmp_path, rows)), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.event_id, r.kind, r.delta) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "added", 3.0), (1, "deleted", -3.0), (2, "deleted", 0.0), (3, "added", 5.0), (4, "modified", -1.0)}
