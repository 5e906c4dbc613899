from tallyroute.plans import inputs
from tallyroute.plans.answers import calendar_answer, traffic_answer


def test_headers_count_the_rows_returned(spark, sf_dir):
    asked, marts = inputs.raw_requests(spark, sf_dir), inputs.marts(spark, sf_dir)
    for limit in (None, 0, 2):
        answer = traffic_answer(asked, marts, limit)
        found = {r.request_id: r["count"] for r in answer.rows.groupBy("request_id").count().collect()}
        headers = {r.request_id: r["count"] for r in answer.headers.collect()}
        assert headers == {i: found.get(i, 0) for i in headers}
        assert len(headers) + answer.refused.count() == asked.count()


def test_calendar_answer(spark):
    asked = spark.createDataFrame(
        [(1, "20241225", "20250112"), (2, "2024-12-25", "20250112"), (3, "20250105", "20250105")],
        "request_id long, date_debut string, date_fin string",
    )
    answer = calendar_answer(asked)
    headers = {r.request_id: tuple(r)[1:] for r in answer.headers.collect()}
    assert headers == {1: ("20241225", "20250112", 16, 3), 3: ("20250105", "20250105", 0, 1)}
    weeks = [tuple(r)[1:] for r in answer.rows.filter("request_id = 3").collect()]
    assert weeks == [("2025-S01", "20250105", "20250105", 0)]
    assert [(r.request_id, r.motif) for r in answer.refused.collect()] == [(2, "format_date_debut")]
