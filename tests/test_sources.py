"""Readers and sinks on small files, and the stream against the batch."""

import json

import pytest
from pyspark.sql import functions as F

from matchlake.operators import feed
from matchlake.sources import catalog
from matchlake.streaming import feed as stream

CSV = """﻿Slug,Название вина,Винодельня,Сорт винограда,svoe_vino_public_rating,svoe_vino_dishes_json,Регион,svoe_vino_region
a-1,"Вино, первое",Фанагория,"Шардоне; Пино","4,2","[""рыба"",""сыр""]",Кубань,
a-1,Второе,Другая,,,,,
,Без слага,,,,,,
b-2,"Две
строки",,,x,,Крым,Севастополь
"""


def test_csv_cards(spark, tmp_path):
    (tmp_path / "c.csv").write_text(CSV)
    rows = {r["slug"]: r for r in catalog.load(spark, str(tmp_path / "c.csv")).collect()}
    assert set(rows) == {"a-1", "b-2"}
    a, b = rows["a-1"], rows["b-2"]
    assert (a["name"], a["winery"], a["grapes"], a["public_rating"], a["dishes"], a["region"]) == ("Вино, первое", "Фанагория", ["Шардоне", "Пино"], 4.2, ["рыба", "сыр"], "Кубань")
    assert (b["name"], b["winery"], b["public_rating"], b["image_url"], b["region"], b["grapes"]) == ("Две\nстроки", "", None, None, "Севастополь", [])
    assert catalog.card(catalog.load(spark, str(tmp_path / "c.csv")), "b-2").count() == 1


def test_json_cards(spark, tmp_path):
    wrapped = {"data": [{"id": 1, "attributes": {"slug": "s", "name": "n", "winery": "w", "grapes": ["x"], "public_rating": 4.2, "image_name": "p", "dishes": ["d"]}}]}
    (tmp_path / "w.json").write_text(json.dumps(wrapped))
    row = catalog.load(spark, str(tmp_path / "w.json")).first()
    assert (row["slug"], row["grapes"], row["public_rating"], row["dishes"]) == ("s", ["x"], 4.2, ["d"])
    (tmp_path / "bad.json").write_text(json.dumps({"data": [{"other": "value"}]}))
    with pytest.raises(ValueError):
        catalog.load(spark, str(tmp_path / "bad.json"))


def test_cards_kept_as_json(spark):
    rows = spark.createDataFrame([('{"slug":"b","name":"n","unknown":1}',), ('{"slug":"a"}',)], "card string")
    assert [r["slug"] for r in catalog.from_json_cards(rows).collect()] == ["a", "b"]


def test_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(b"\xff\xd8\xff123")
    (tmp_path / "b.txt").write_bytes(b"no")
    row = catalog.read_images(spark, str(tmp_path)).collect()
    assert [(r["name"], r["mime"], len(r["digest"])) for r in row] == [("a.jpg", "image/jpeg", 64)]


def test_selection_and_references(spark):
    rows = spark.createDataFrame([("a-1",), ("a-2",), ("b",)], "slug string")
    assert [r["slug"] for r in catalog.select_slugs(rows, prefix="a-", skip=["a-2"]).collect()] == ["a-1"]
    assert catalog.select_slugs(rows, only=["b", "z"]).count() == 1
    refs = spark.createDataFrame([("v1", "ok", "x"), ("v1", "ok", " "), ("v0", "ok", "x"), ("v1", "error", "x")], "version string, status string, text string")
    assert catalog.references(refs, "v1").count() == 1


def test_weights_of_other_features_are_an_error(tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"features": ["a", "b"], "weights": [1, 2]}))
    assert catalog.load_weights(str(tmp_path / "w.json"), ["a", "b"]) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        catalog.load_weights(str(tmp_path / "w.json"), ["b", "a"])


def test_lines_are_appended_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    out = str(tmp_path / "out")
    assert catalog.append_lines(rows, out, ["id"]) == 2
    assert catalog.append_lines(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), out, ["id"]) == 1
    assert spark.read.json(out).count() == 3


def test_script_payload(spark):
    html = '<html><script type="text/javascript">x</script><script id="d" type="application/json">{"a": [1]}</script>'
    assert spark.range(1).select(catalog.script_json(F.lit(html)).alias("x")).first()["x"] == '{"a": [1]}'


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 3}", i, "matched" if i % 2 else "unknown") for i in range(30)], "id long, slug string, s long, status string").withColumn("ts", F.timestamp_seconds(F.col("s") * 1000 + 1_000_000_000))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    own = stream.matched_only(stream.event_stream(spark, str(tmp_path / "in"), rows.schema))
    found = stream.drain(stream.recent(own, "slug"), "recent_test", str(tmp_path / "ck"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in feed.recent_distinct(rows.where("status = 'matched'"), "slug").collect()}
    stream.drain_to(stream.once_each(stream.event_stream(spark, str(tmp_path / "in"), rows.schema), "id", late="10 hours"), str(tmp_path / "out"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
