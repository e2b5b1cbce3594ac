import datetime

from logweave.plans import queries


def test_every_line_has_its_place_in_the_whole_day(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "TEXT_FILE_LINES", 10)
    start = datetime.datetime(2024, 1, 1)
    rows = [(n, start + datetime.timedelta(hours=n % 2 * 24), n, "view", 1.5, "{}") for n in range(150)]
    rows += [(None, start, 7, "view", 1.5, "{}"), (200, None, 7, "view", 1.5, "{}")]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    found = queries.read_text_log(spark, str(tmp_path)).collect()
    expected = {r.line_no: r.line for r in queries._lines(spark, str(tmp_path)).collect()}
    known = [r for r in found if r.day is not None]
    # A line without a number comes last in its day.
    last = known.pop([(r.day, r.place) for r in known].index(("2024-01-01", 76)))
    assert last.line == expected[None]
    assert sorted((r.day, r.place) for r in known) == [(f"2024-01-0{d}", n) for d in (1, 2) for n in range(1, 76)]
    # Line numbers start at 1; the first day has the odd ones.
    assert all(r.line == expected[2 * r.place - (1 if r.day == "2024-01-01" else 0)] for r in known)
    assert [(r.place, r.line) for r in found if r.day is None] == [(1, None)]
