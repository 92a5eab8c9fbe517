"""Entry points, label lines and model seams."""

import pytest
from pyspark.sql import functions as F

from matchlake import engine
from matchlake.operators import labels, lexical
from matchlake.sources import seams


def unit(i, n=6):
    return [1.0 if j == i else 0.1 for j in range(n)]


def setting(spark):
    gallery = spark.createDataFrame([("rkatsiteli", 100, unit(0)), ("muscat", 101, unit(1)), ("krasnostop", 102, unit(2))], "entity string, item long, v array<double>")
    queries = spark.createDataFrame([(1, unit(0)), (2, [0.5] * 6)], "query_id long, v array<double>")
    index = lexical.build_index(spark.createDataFrame([("rkatsiteli", "loco", 2.0), ("rkatsiteli", "ркацители", 1.5), ("muscat", "loco", 2.0), ("muscat", "мускат", 2.0), ("krasnostop", "красностоп", 2.0)], "entity string, token string, weight double"))
    texts = spark.createDataFrame([(1, "loco", 1.0), (2, "красностоб", 1.0), (2, "мускат", 0.1)], "query_id long, word string, weight double")
    return queries, gallery, texts, index


def numbered(gallery):
    """Entities as numbers, as the tiles of a search take them."""
    return gallery.withColumn("entity", F.col("item") - 100)


def test_resolve_in_each_mode(spark):
    queries, gallery, texts, index = setting(spark)
    names = gallery.select("entity", (F.col("item") - 100).alias("no"))
    own = lexical.TextIndex(*[t.join(names, "entity").drop("entity").withColumnRenamed("no", "entity") for t in (index.fields,)], index.idf, index.norms.join(names, "entity").drop("entity").withColumnRenamed("no", "entity"))
    groups = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "entity long, group string")
    found = engine.resolve(queries, numbered(gallery), texts, own, groups).collect()
    top = {r["query_id"]: r for r in found if r["rank"] == 1}
    assert top[1]["entity"] == 0 and top[2]["entity"] == 2 and top[1]["status"] == "matched"
    for q in (1, 2):
        assert abs(sum(r["probability"] for r in found if r["query_id"] == q) - 1) < 1e-9
    picture = {r["query_id"]: r["entity"] for r in engine.top1(engine.resolve(queries, numbered(gallery), mode="image_full")).collect()}
    text = {r["query_id"]: r["entity"] for r in engine.top1(engine.resolve(queries, numbered(gallery), texts, own, mode="ocr_full")).collect()}
    assert picture[1] == 0 and text[2] in (1, 2)
    with pytest.raises(ValueError):
        engine.resolve(queries, gallery, mode="other")


def test_boxes_of_a_frame(spark):
    rows = spark.createDataFrame([(1, [0.4, 0.1, 0.6, 0.9], 0.9), (1, [0.41, 0.1, 0.6, 0.9], 0.8), (1, [0.0, 0.1, 0.15, 0.5], 0.5), (1, [0.4, 0.4, 0.41, 0.42], 0.9)], "image long, box array<double>, score double")
    found = engine.rank_boxes(rows).orderBy("rank").collect()
    assert [r["rank"] for r in found] == [1, 2] and found[0]["box"][0] == 0.4 and not found[0]["ambiguous"]


def test_weights_of_label_words(spark):
    box = lambda x, y, h: [[float(a), float(b)] for a, b in ((x, y), (x + 100, y), (x + 100, y + h), (x, y + h))]
    rows = spark.createDataFrame([(1, "mid", 1.0, box(450, 100, 50)), (1, "edge", 1.0, box(0, 100, 50)), (1, "small", 1.0, box(450, 100, 5)), (1, "none", 1.0, [])], "query_id long, text string, score double, box array<array<double>>").withColumn("width", F.lit(1000)).withColumn("height", F.lit(1000))
    found = {r["text"]: r["weight"] for r in labels.words_of_lines(rows).collect()}
    assert set(found) == {"mid", "edge", "small"} and found["mid"] == 1.0 and abs(found["edge"] - 0.2) < 0.05 and abs(found["small"] - 0.46) < 1e-9
    inside = labels.on_label(rows, F.lit(0.4), F.lit(0.05), F.lit(0.6), F.lit(0.2))
    assert sorted(r["text"] for r in inside.collect()) == ["mid", "small"]


def test_series_and_lines(spark):
    rows = spark.createDataFrame([("Мезыбь Рубин", "mezyb-rubin"), ("Шишка Мезыбь", "x"), ("Вино", "loco-cimbali-1"), ("Вино", "y")], "name string, slug string")
    assert [r["x"] for r in rows.select(labels.confusable_series(F.col("name"), F.col("slug")).alias("x")).collect()] == [True, False, True, False]
    lines = spark.createDataFrame([(1, 0, ["series", "title"], 0.0, 10.0), (1, 1, ["rubin"], 12.0, 20.0), (1, 2, ["pinot", "rubin"], 30.0, 40.0), (2, 0, ["series"], 0.0, 10.0), (2, 1, ["x"], 8.0, 20.0)], "query_id long, line_no int, words array<string>, top double, bottom double")
    candidates = spark.createDataFrame([(q, e, m) for q in (1, 2) for e, m in (("a", ["series", "rubin"]), ("b", ["series", "pinot"]))], "query_id long, entity string, markers array<string>")
    assert sorted(tuple(r) for r in labels.telling_line(lines, candidates).collect()) == [(1, 1), (2, 1)]
    wanted = spark.createDataFrame([(1, ["rubin", "pinot"])], "query_id long, words array<string>")
    assert tuple(labels.best_line(lines, wanted).first()) == (1, 2, 2)
    crop = spark.range(1).select(labels.quad_crop(F.array(F.array(F.lit(10.0), F.lit(10.0)), F.array(F.lit(110.0), F.lit(30.0))), F.lit(1000), F.lit(1000)).alias("x")).first()["x"]
    assert crop == [0, 6, 130, 34]


def test_promotion_by_the_line_photo(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.87), (1, "c", 3, 0.86), (1, "d", 4, 0.5)], "query_id long, entity string, rank int, visual double")
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.52), (1, "c", 0.6), (1, "d", 0.9)], "query_id long, entity string, line_score double")
    assert labels.promote_by_line(ranked, scores).where("rank = 1").first()["entity"] == "c"


def test_markers_and_evidence(spark):
    row = spark.range(1).select(labels.markers(F.lit("Усадьба Рубин"), F.lit("сухое"), F.array(F.lit("Пино Нуар"))).alias("m"), labels.has_evidence(F.array(F.lit("рубин"), F.lit("2020"), F.lit("пино"))).alias("yes"), labels.has_evidence(F.array(F.lit("the"), F.lit("рубин"))).alias("no")).first()
    assert set(row["m"]) == {"рубин", "пино", "нуар", "сухое"} and row["yes"] and not row["no"]


def test_models_behind_seams(spark):
    images = spark.createDataFrame([("a", "m", "1", bytearray(b"LOCO\nab\n")), ("b", "m", "2", bytearray(b"x"))], "entity string, model string, digest string, content binary")
    have = images.select("entity", "model", "digest").where("entity = 'a'")
    new = seams.index_new(images.drop("model"), have, lambda: seams.hash_encoder(8), "m").collect()
    assert [r["entity"] for r in new] == ["b"] and abs(sum(x * x for x in new[0]["vector"]) - 1) < 1e-9
    read = seams.usable_lines(seams.apply_model(images, seams.line_reader, "lines", seams.LINES)).orderBy("entity").collect()
    assert [[x["text"] for x in r["lines"]] for r in read] == [["LOCO"], []]

    def broken():
        def model(contents):
            raise ValueError("no image")

        return model

    assert seams.apply_model(images, broken, "v", seams.VECTOR).where("v IS NULL").count() == 2


def test_card_index(spark):
    cards = spark.createDataFrame([("loco-rk", "Loco Ркацители", "Loco", ["Ркацители"], "Белое", "белое")], "slug string, name string, winery string, grapes array<string>, category string, colour string")
    rows = {(r["token"], r["weight"]) for r in labels.index_rows(labels.card_documents(cards)).collect()}
    assert ("ркацители", 2.0) in rows and ("loco", 1.5) in rows and not any(t == "белое" for t, _ in rows)
