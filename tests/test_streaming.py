from logweave.streaming.matching import match_stream, parse_stream, read_line_stream


def test_stream_is_matched_to_a_catalogue(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.log").write_text("[t] [notice] child 1 started\njunk\n")
    catalogue = spark.createDataFrame(
        [("a.log", "Event1", "child <*> started"), ("b.log", "Event1", "x <*>")],
        "log_id string, EventId string, EventTemplate string",
    )

    def run():
        masked = parse_stream(read_line_stream(spark, str(source)), "Apache")
        match_stream(masked, catalogue, 0.5, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    run()
    (source / "b.log").write_text("[t] [error] x 9\n[t] [error] y z w q\n")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.log_id, r.Content, r.EventId) for r in rows if r.EventId) == [
        ("a.log", "child 1 started", "Event1"), ("b.log", "x 9", "Event1"),
    ]
    assert [r.Content for r in rows if r.EventId is None] == ["y z w q"]
