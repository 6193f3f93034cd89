import pytest
from pyspark.sql import functions as F

from quillmill.operators.agents import Service, Tools, call_model, echo_model, route
from quillmill.sources.sinks import add_sessions, last_values, with_columns


def test_route_and_models(spark):
    df = spark.createDataFrame([("hi",), ("latest news",), ("the handbook says",), ("latest policy",), (None,)], "q string")
    assert [r.route for r in route(df, "q").collect()] == ["direct", "external", "retrieve", "both", "retrieve"]
    assert [r.route for r in route(df, "q", lambda qs: ["odd"] * len(qs)).collect()] == ["retrieve"] * 5
    assert [r.a for r in call_model(df, "q", "a", echo_model).collect()][0] == "hi"


def test_tools(spark):
    tools = Tools()
    tools.add("upper", F.upper)
    tools.add("size", lambda c: F.length(c).cast("string"))
    df = spark.createDataFrame([("upper", "a"), ("size", "abc"), ("none", "x")], "n string, a string")
    assert [r[0] for r in df.select(tools.apply(F.col("n"), F.col("a"))).collect()] == ["A", "3", None]


def test_service(spark):
    sessions = spark.sql("select 'a' as session_id, 't' as title, timestamp '2024-01-01' as created_at, timestamp '2024-01-02' as updated_at")
    messages = spark.sql("select 'a' as session_id, 1L as id, 'human' as role, 'x' as content, timestamp '2024-01-01' as created_at")
    s = Service(sessions, messages, spark.sql("select 'c' as collection"), spark.sql("select 'p' as file_path, 'h' as file_hash, 'done' as status, 1 as attempt_count, timestamp '2024-01-01' as last_attempt"))
    assert s.list().count() == 1 and s.get("a").count() == 1
    with pytest.raises(KeyError):
        s.get("b")
    assert [x.count() for x in s.health()] == [1, 1]
    good, bad = s.valid(spark.createDataFrame([("m",), ("",), (None,)], "message string"))
    assert (good.count(), bad.count()) == (1, 2)


def test_small_sinks(spark):
    have = spark.createDataFrame([("a", "old")], "session_id string, title string")
    new = spark.createDataFrame([("a", "new"), ("b", "x"), ("b", "x"), (None, "y")], "session_id string, title string")
    assert sorted(map(tuple, add_sessions(have, new).collect())) == [("a", "old"), ("b", "x")]
    events = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), (None, "3", 3)], "session_id string, title string, at int")
    assert [r.title for r in last_values(events, "title").collect()] == ["2"]
    assert with_columns(have, {"n": 0, "title": "z"}).first().asDict() == {"session_id": "a", "title": "old", "n": 0}
