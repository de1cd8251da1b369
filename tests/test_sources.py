import json
import uuid

from pyspark.sql import functions as F, types as T

from spindle.sources import files
from spindle.streaming.events import event_stream, streamed_metrics, streamed_windows, upsert_sink


def test_content_list(spark, tmp_path):
    (tmp_path / "a_content_list.json").write_text(json.dumps([{"type": "image", "img_path": "images/x.png", "img_caption": ["c"]}, {"type": "text", "text": "t", "other": 1}, {"type": "image", "img_path": "../../etc/x.png"}]))
    b = files.read_content_lists(spark, str(tmp_path), "/base").orderBy("block_idx").collect()
    assert [x["type"] for x in b] == ["image", "text", "image"] and b[0]["image_caption"] == ["c"] and b[0]["img_path"] == "/base/images/x.png" and b[2]["img_path"] == ""


def test_store_lines_and_sheet(spark, tmp_path):
    (tmp_path / "kv.json").write_text(json.dumps({"k1": {"v": 1}, "k2": {"v": 2}}))
    kv = files.read_store(spark, str(tmp_path / "kv.json"), T.StructType([T.StructField("v", T.IntegerType())]))
    assert {tuple(r) for r in kv.collect()} == {("k1", 1), ("k2", 2)}
    files.write_json_lines(kv, str(tmp_path / "lines"))
    assert files.read_json_lines(spark, str(tmp_path / "lines"), kv.schema).count() == 2
    files.write_sheet(kv, str(tmp_path / "sheet"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sheet")).columns == ["key", "v"]


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("b<&", "虫害"), ("a", 'x"y')], "id string, entity_type string")
    edges = spark.createDataFrame([("a", "b<&", "危害")], "source string, target string, relation string")
    files.write_graphml(nodes, edges, str(tmp_path / "g"), ["entity_type"], ["relation"])
    n, e = files.read_graphml(spark, str(tmp_path / "g"))
    assert {(r["id"], r["attributes"]["entity_type"]) for r in n.collect()} == {("b<&", "虫害"), ("a", 'x"y')}
    assert [(r["source"], r["target"], r["attributes"]["relation"]) for r in e.collect()] == [("a", "b<&", "危害")]


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/A.PDF").write_text("x")
    (tmp_path / "b.py").write_text("x")
    f = files.read_folder(spark, str(tmp_path))
    assert {(r["path"].rpartition("/")[2], r["kind"]) for r in f.collect()} == {("A.PDF", "pdf"), ("b.py", "other")}
    assert files.supported_files(f, [".pdf"]).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = "select id event_id, timestamp_ntz'2024-01-01' + make_dt_interval(id % 3) ts, id % 4 user_id, if(id % 2 = 0, 'a', 'b') event_type, cast(id as double) value from range(40)"
    spark.sql(rows).repartition(4).write.parquet(path)
    from spindle.operators.state import event_metrics, windowed_counts

    batch = spark.read.parquet(path)
    assert {tuple(r) for r in streamed_metrics(spark, path, "m1").collect()} == {tuple(r) for r in event_metrics(batch).collect()}
    assert {tuple(r) for r in streamed_windows(spark, path, "w1").collect()} == {tuple(r) for r in windowed_counts(batch).collect()}
    seen = []
    upsert_sink(event_stream(spark, path, 2).groupBy("event_type").agg(F.count("*").alias("n")), lambda df, i: seen.append(df.count()), uuid.uuid4().hex).awaitTermination()
    assert sum(seen) >= 2


def test_entry():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 50
