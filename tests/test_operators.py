"""Operators on the hand-checked fixtures and on invariants."""

import math

import numpy as np
from pyspark.sql import functions as F

from matchlake.functions import geometry as G
from matchlake.functions import tables as T
from matchlake.operators import decide, evaluate, feed, fusion, lexical, recommend, vector

HITS = "query_id long, entity string, item string, score double, ord int"


def hits(spark, *rows, schema=HITS):
    return spark.createDataFrame([(1, e, i, s, n) for n, (e, i, s) in enumerate(rows)], schema)


def test_best_by_entity(spark):
    found = vector.best_by_entity(hits(spark, ("a", "1", 0.81), ("a", "2", 0.94), ("b", "3", 0.90), ("c", "4", 0.70)), 2).orderBy(F.desc("score")).collect()
    assert [(r["entity"], r["score"]) for r in found] == [("a", 0.94), ("b", 0.90)]
    first = vector.best_by_entity(hits(spark, ("a", "9", 0.5), ("a", "1", 0.5))).first()
    assert first["item"] == "9"  # the first of equal ones


def test_full_and_crop_views(spark):
    found = vector.split_full_crop(hits(spark, ("a", "full", 0.71), ("a", "crop", 0.88), ("b", "full", 0.5), ("b", "crop", 0.5), ("c", "full", 0.3)), F.col("item") == "crop").orderBy("entity").collect()
    assert [(r["full_score"], r["crop_score"], r["best_view"]) for r in found] == [(0.71, 0.88, "crop"), (0.5, 0.5, "crop"), (0.3, None, "full")]


def test_fused_models_default_to_each_other(spark):
    found = vector.fuse_models(hits(spark, ("a", "1", 0.90), ("a", "2", 0.70), ("b", "1", 0.86)), hits(spark, ("a", "1", 0.60), ("b", "1", 0.80), ("c", "1", 0.4))).orderBy("entity").collect()
    assert [round(r["score"], 6) for r in found] == [0.75, 0.83, 0.4]


def test_rescore_is_that_of_all_pairs_without_a_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE", 4)
    rng = np.random.default_rng(1)
    v, entity = rng.standard_normal((60, 8)), rng.integers(0, 3, 60)
    entity[59] = 9  # an entity whose only item is the query's own
    gallery = spark.createDataFrame([(int(entity[i]), i, v[i].tolist()) for i in range(60)], "entity long, item long, v array<double>")
    asked = [(q, int(e)) for q in range(60) for e in rng.choice(3, 2, replace=False)] + [(59, 9), (5, 9), (5, 7)]
    found = vector.rescore(spark.createDataFrame(asked * 2, "query_id long, entity long"), gallery.select(F.col("item").alias("query_id"), "v"), gallery)
    want = {(q, e): round(max(v[q] @ v[i] for i in range(60) if entity[i] == e and i != q), 6) for q, e in asked if any(entity[i] == e and i != q for i in range(60))}
    assert {(r["query_id"], r["entity"]): r["score"] for r in found.collect()} == want and (59, 9) not in want and (5, 7) not in want
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().toString()


def test_top_entities_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector, "TILE", 16)
    rng = np.random.default_rng(0)
    v, entity = rng.standard_normal((50, 8)), rng.integers(0, 7, 50)
    gallery = spark.createDataFrame([(int(entity[i]), i, v[i].tolist()) for i in range(50)], "entity long, item long, v array<double>")
    found = vector.top_entities(gallery.select(F.col("item").alias("query_id"), "v"), gallery, k=3).collect()
    for q in range(50):
        best = {}
        for i in range(50):
            if i != q:
                s = round(float(v[q] @ v[i]), 6)
                if s > best.get(entity[i], (-9,))[0]:
                    best[entity[i]] = (s, i)
        want = sorted(((-s, e, i) for e, (s, i) in best.items()))[:3]
        own = sorted((-r["score"], r["entity"], r["item"]) for r in found if r["query_id"] == q)
        assert [(e, i) for _, e, i in own] == [(e, i) for _, e, i in want]
    near = vector.lsh_candidates(gallery.select(F.col("item").alias("query_id"), "v"), gallery, 8, bits=4, bands=6)
    assert near.where("query_id = item").count() == 50


def test_decisions(spark):
    def status(*scores):
        return decide.with_margin(hits(spark, *[(str(i), "x", s) for i, s in enumerate(scores)])).where("rank = 1").select(decide.visual_status(F.col("score"), F.col("margin")).alias("s")).first()["s"]

    assert [status(*s) for s in ((0.76, 0.70), (0.74, 0.71), (0.871, 0.864), (0.738, 0.702), (0.80, 0.79), (0.40, 0.38), (0.9,))] == ["matched", "uncertain", "matched", "matched", "uncertain", "unknown", "matched"]
    lead = lambda p, r: spark.range(1).select(decide.share_leads(F.lit(p), F.lit(r)).alias("x")).first()["x"]
    assert [lead(*x) for x in ((0.575, 0.194), (0.50, 0.40), (0.52, 0.45), (0.49, 0.20))] == [True, True, False, False]
    veto = spark.range(1).select(decide.visual_status(F.lit(0.9), F.lit(0.1), usable=F.lit(False)).alias("a"), decide.visual_status(F.lit(0.9), F.lit(0.1), corroborated=F.lit(True), usable=F.lit(False)).alias("b")).first()
    assert tuple(veto) == ("uncertain", "matched")


def test_pseudo_f1_and_family_margin(spark):
    f1 = lambda *s: decide.pseudo_f1(hits(spark, *[(str(i), "x", v) for i, v in enumerate(s)])).first()["f1_top1"]
    assert f1(0.95, 0.94) < f1(0.95, 0.70)
    rows = hits(spark, ("a", "x", 0.9), ("b", "x", 0.89), ("c", "x", 0.7)).withColumn("family", F.when(F.col("entity") == "c", 2).otherwise(1))
    assert decide.distinct_margin(rows, "family").first()["margin"] == 0.2
    assert decide.distinct_margin(rows.where("entity != 'c'"), "family").first()["margin"] == 0.9


def catalogue(spark):
    rows = [("loco-rkatsiteli", "loco", 2.0), ("loco-rkatsiteli", "cimbali", 2.0), ("loco-rkatsiteli", "ркацители", 1.5), ("loco-muscat", "loco", 2.0), ("loco-muscat", "мускат", 1.5), ("sober-krasnostop", "красностоп", 2.0), ("sober-krasnostop", "sober", 0.8)]
    return lexical.build_index(spark.createDataFrame(rows, "entity string, token string, weight double"))


def test_text_search_resolves_typos_and_glued_words(spark):
    index = catalogue(spark)
    words = spark.createDataFrame([(w,) for w in ("loco", "красностоб", "locoмускат", "zzzzzz", "abc")], "word string")
    found = {(r["word"], r["token"], r["factor"]) for r in lexical.resolve(words, index.idf).collect()}
    assert found == {("loco", "loco", 1.0), ("красностоб", "красностоп", 0.6), ("locoмускат", "loco", 0.8), ("locoмускат", "мускат", 0.8)}
    idf = {r["token"]: r["idf"] for r in index.idf.collect()}
    assert math.isclose(idf["loco"], math.log(4 / 3) + 1)
    asked = spark.createDataFrame([(1, "loco", 1.0), (1, "ркацители", 0.5), (1, "cimbali", 1.0), (2, "красностоб", 1.0)], "query_id long, word string, weight double")
    told = lexical.contributions(asked, index, lexical.resolve(asked.select("word").distinct(), index.idf))
    top = {r["query_id"]: r["entity"] for r in vector.ranked(lexical.evidence(told, index)).where("rank = 1").collect()}
    assert top == {1: "loco-rkatsiteli", 2: "sober-krasnostop"}
    groups = spark.createDataFrame([("loco-rkatsiteli", "loco"), ("loco-muscat", "loco"), ("sober-krasnostop", "")], "entity string, group string")
    against = {r["entity"]: r["contradiction"] for r in lexical.contradiction(told, groups, told).where("query_id = 1").collect()}
    assert against["loco-muscat"] > 0 and against["loco-rkatsiteli"] == 0


def test_catalogue_search(spark):
    catalog = spark.createDataFrame([("fanagoria-blanc", "Фанагория Blanc de Blancs"), ("massandra", "Массандра Мускат")], "entity string, text string")
    found = lexical.search(spark.createDataFrame([(1, "Фанагория Blanc de Blancs"), (2, "qqq")], "query_id long, text string"), catalog).collect()
    assert [r["entity"] for r in found if r["query_id"] == 1][0] == "fanagoria-blanc" and found[0]["score"] > 0.55
    assert all(r["score"] >= 0.25 for r in found)


def test_style_votes_take_the_first_of_equal_ones(spark):
    rows = spark.createDataFrame([(1, "colour", "red", 0.3, 2), (1, "colour", "white", 0.3, 1), (1, "sweetness", "dry", 0.1, 1)], "query_id long, group string, style string, weight double, ord int")
    assert [(r["group"], r["style"]) for r in lexical.style_votes(rows).collect()] == [("colour", "white")]


def test_ranker_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([(q, e, 0.5 + 0.1 * e, float(e % 2), 0.1, 0, 1, -1, 0.0, 0.0) for q in (1, 2) for e in range(5)], "query_id long, entity long, visual double, text double, coverage double, sweetness int, colour int, year int, contradiction double, photo double")
    found = fusion.rank(fusion.features(rows)).collect()
    for q in (1, 2):
        own = [r for r in found if r["query_id"] == q]
        assert math.isclose(sum(r["probability"] for r in own), 1) and max(own, key=lambda r: r["logit"])["rank"] == 1
    features = fusion.features(rows).where("query_id = 1").orderBy("entity").collect()
    assert [r["text_leader"] for r in features] == [0, 1, 0, 1, 0] and features[1]["text_margin"] == 0  # equal best texts


def test_a_sibling_that_alone_explains_words_comes_first(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 0.90), (1, "b", 2, 0.87), (1, "c", 3, 0.86), (2, "a", 1, 0.9), (2, "b", 2, 0.8)], "query_id long, entity string, rank int, visual double")
    told = spark.createDataFrame([(q, e, w, v) for q in (1, 2) for e, w, v in (("a", "x", 0.5), ("b", "y", 2.5), ("b", "x", 0.5), ("a", "z", 0.2))], "query_id long, entity string, word string, value double")
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g")], "entity string, group string")
    found = fusion.sibling_override(ranked, told, groups).where("rank = 1").orderBy("query_id").collect()
    assert [r["entity"] for r in found] == ["b", "a"]


def test_promotion_and_lock(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.9, 0.0, 0.9), (1, "b", 2, 0.86, 0.1, 0.95), (2, "a", 1, 0.9, 0.0, 0.9), (2, "b", 2, 0.8, 0.02, 0.95)], "query_id long, entity string, rank int, visual double, delta double, score double")
    assert [r["entity"] for r in decide.promote(rows, F.col("entity") == "b").where("rank = 1 AND query_id = 1").collect()] == ["b"]
    found = {(r["query_id"], r["rank"]): r["entity"] for r in decide.lock_leader(rows, "visual", "delta").collect()}
    assert found[1, 1] == "b" and found[2, 1] == "a"


def test_recommendation_rules(spark):
    rows = [("fanagoria-cabernet", "красное сухое каберне", "мясо", 4.0), ("usadba-pinot", "красное сухое пино", "рыба", 4.0), ("massandra-muskatel", "белое сладкое мускат", "десерт", 4.5), ("brut", "игристое брют", "рыба", 4.0)]
    catalog = spark.createDataFrame([(e, b, b, d, "", 12.0, r, False, i) for i, (e, b, d, r) in enumerate(rows)], "entity string, blob string, grapes string, dishes string, region string, alcohol double, rating double, has_photo boolean, ord int")
    ask = lambda o, c, s: spark.createDataFrame([(1, o, c, s, "", "", None, None, None)], "query_id int, occasion string, colour string, sweetness string, grape string, region string, alcohol_min double, alcohol_max double, exclude string")
    best = lambda *a: recommend.recommend(recommend.occasion_score(catalog, ask(*a))).where("rank = 1").first()["entity"]
    assert [best("meat", "red", "dry"), best("fish", "red", "any"), best("dessert", "any", "any")] == ["fanagoria-cabernet", "usadba-pinot", "massandra-muskatel"]
    keys = spark.range(1).select(recommend.colour_key(F.lit("красностоп")).alias("c"), recommend.sweetness_key(F.lit("полусладкое")).alias("s"), recommend.swatch(F.lit("золотисто янтарный")).alias("w")).first()
    assert (keys["c"], keys["s"], keys["w"][0]) == ("red", "semi_sweet", "#f8e7a8")
    photo = spark.range(1).select(recommend.has_photo(F.lit("https://x/a_0123abcd.webp?x")).alias("a"), recommend.has_photo(F.lit(None).cast("string")).alias("b")).first()
    assert (photo["a"], photo["b"]) == (True, False)


def test_alternatives_put_photos_first(spark):
    rows = spark.createDataFrame([(1, "a", 5.0, False, 0), (1, "b", 4.0, True, 1), (1, "c", 4.0, True, 2), (1, "d", 0.0, True, 3), (1, "e", 3.0, False, 4)], "query_id int, entity string, score double, has_photo boolean, ord int")
    assert [r["entity"] for r in recommend.alternatives(rows).orderBy("rank").collect()] == ["b", "c", "a"]


def test_taste_and_fit(spark):
    text = F.lit("красное полусладкое плотное")
    row = spark.range(1).select(*[c.alias(n) for n, c in recommend.taste(text, F.array(F.lit("x")), F.lit(14.0)).items()]).first()
    assert (row["sweetness"], row["acidity"], row["aromaticity"], row["body"]) == (5, 3, 2, 5)
    same = {d: F.lit(3.0) for d in recommend.DIMENSIONS}
    none = {d: F.lit(None).cast("double") for d in recommend.DIMENSIONS}
    fits = spark.range(1).select(recommend.fit(same, same, none).alias("a"), recommend.fit(same, same, same).alias("b"), recommend.fit(same, none, none).alias("c")).first()
    assert tuple(fits) == (100, 65, None)


def test_metrics_of_an_identity_gallery(spark):
    gallery = spark.createDataFrame([(i, i + 100, [1.0 if j == i else 0.0 for j in range(5)]) for i in range(5)], "entity long, item long, v array<double>")
    queries = spark.createDataFrame([(q, [1.0 if j == q else 0.0 for j in range(5)]) for q in (0, 1, 3)], "query_id long, v array<double>")
    truth = spark.createDataFrame([(0, 0), (1, 1), (3, 4)], "query_id long, truth long")
    rows = decide.with_margin(vector.top_entities(queries, gallery)).join(truth, "query_id")
    own = rows.groupBy("query_id").agg(F.max(F.when(F.col("entity") == F.col("truth"), F.col("rank"))).alias("rank_of_truth"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 1, F.col("margin"))).alias("margin"), F.max((F.col("rank") == 1) & (F.col("entity") == F.col("truth"))).alias("correct"))
    found = evaluate.retrieval_metrics(own).first()
    assert (round(found["top1"], 6), found["accepted"], found["false_accepts"]) == (0.666667, 3, 1)


def test_calibration(spark):
    rows = spark.createDataFrame([(0.5 + 0.005 * i, 0.05, i > 20) for i in range(100)], "score double, margin double, correct boolean")
    grid = evaluate.threshold_grid(rows, [0.5, 0.6, 0.7], [0.0, 0.1])
    found = {(r["threshold"], r["margin"]): (r["accepted"], r["right"]) for r in grid.collect()}
    assert found == {(0.5, 0.0): (100, 79), (0.6, 0.0): (80, 79), (0.7, 0.0): (60, 60), (0.5, 0.1): (0, 0), (0.6, 0.1): (0, 0), (0.7, 0.1): (0, 0)}
    best = evaluate.choose_threshold(grid).first()
    assert best["threshold"] == 0.6
    k = spark.range(1).select(evaluate.wilson_lower(F.lit(0), F.lit(0)).alias("a"), evaluate.wilson_lower(F.lit(10), F.lit(10)).alias("b")).first()
    assert k["a"] == 0 and 0.7 < k["b"] < 0.75
    low, mean, high = evaluate.paired_bootstrap(spark.createDataFrame([(i, 0.0, float(i % 2)) for i in range(100)], "g long, a double, b double"), "g", "a", "b", 200).first()
    assert low < mean < high and abs(mean - 0.5) < 0.05


def test_conditional_logit_finds_the_feature_that_decides(spark):
    rng = np.random.default_rng(0)
    rows = [(q, float(x := rng.standard_normal()), float(rng.standard_normal()), x) for q in range(60) for _ in range(4)]
    best = {q: max(r[3] for r in rows if r[0] == q) for q in range(60)}
    frame = spark.createDataFrame([(q, a, b, x == best[q]) for q, a, b, x in rows], "query_id long, a double, b double, correct boolean")
    w = evaluate.conditional_logit(frame, ["a", "b"], steps=10)
    assert w[0] > 1 and abs(w[1]) < w[0] / 3


def test_boxes(spark):
    box = lambda *b: F.array(*[F.lit(float(x)) for x in b])
    row = spark.range(1).select(
        G.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)).alias("iou"), G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("none"), G.crop_quality(box(0.4, 0.1, 0.5, 0.2)).alias("bad"), G.crop_quality(box(0.1, 0.2, 0.9, 0.9)).alias("good"),
        G.shelf_region(box(0.2, 0.3, 0.5, 0.6)).alias("shelf"), G.shelf_region(box(0, 0, 1, 1)).alias("frame"), G.shoelace(F.array(box(0, 0), box(2, 0), box(2, 1), box(0, 1))).alias("area"),
    ).first()
    assert math.isclose(row["iou"], 1 / 3) and row["none"] == 0 and row["good"] == [] and row["bad"] == ["tiny_region", "small_upper_fragment"]
    assert [round(x, 2) for x in row["shelf"]] == [0.16, 0.14, 0.54, 0.63] and row["frame"] is None and row["area"] == 2
    rows = spark.createDataFrame([(1, [0.0, 0.0, 0.5, 0.5], 0.9, 1), (1, [0.01, 0.0, 0.5, 0.5], 0.8, 2), (1, [0.6, 0.6, 1.0, 1.0], 0.7, 3)], "image long, box array<double>, priority double, no int")
    assert sorted(r["no"] for r in evaluate.greedy_nms(rows).collect()) == [1, 3]


def test_state_tables(spark):
    profiles = spark.createDataFrame([("x", "{}")], "profile_id string, state string")
    assert feed.get_or_create(profiles, spark.createDataFrame([("t",), ("t",)], "token string")).count() == 2
    r = spark.range(1).select(
        feed.valid_ratings(F.create_map(F.lit("a"), F.lit(5))).alias("ok"), feed.valid_ratings(F.create_map(F.lit("a"), F.lit(6))).alias("bad"), feed.toggled(F.array(F.lit("a")), F.lit("a")).alias("off"),
        feed.toggled(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("d")).alias("full"), feed.prepended(F.array(F.lit("a"), F.lit("b")), F.lit("b"), 2).alias("first"),
    ).first()
    assert (r["ok"], r["bad"], r["off"], r["full"], r["first"]) == (True, False, [], ["a", "b", "c"], ["b", "a"])


def test_feed_over_fetch_may_return_fewer(spark):
    events = spark.createDataFrame([(k, t) for t, k in enumerate("aabbcd")], "slug string, ts int")
    known = spark.createDataFrame([("a",), ("b",)], "slug string")
    assert [r["slug"] for r in feed.feed(events, known, "slug", 1).collect()] == ["b"]
    assert feed.feed(events, known, "slug", 1, over_fetch=2).count() == 0


def test_weights_keep_their_order():
    assert list(T.RANKER)[:2] == ["visual_gap", "visual_far"] and len(T.RANKER) == 13


def test_resolve_equals_all_pairs_at_every_length(spark):
    """Words one or two edits from tokens of 4 to 40 letters and one of 3,000, against all pairs."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    tokens = sorted({"".join(rng.choice("abcde") for _ in range(n)) for n in range(4, 41) for _ in range(3)})
    huge = "".join(rng.choice("abcdefgh") for _ in range(3000))
    asked = set()
    for t in [*tokens, huge]:
        for edits in (1, 2, 3):
            w = t
            for _ in range(edits):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("abcde")) + w[at + (kind < 2) :]
            asked.add(w)
    asked = sorted(asked - {*tokens, huge})
    idf = spark.createDataFrame([(t, 1, 1.0) for t in [*tokens, huge]], "token string, df long, idf double")
    words = spark.createDataFrame([(w,) for w in asked], "word string")
    found = {r["word"]: r["token"] for r in lexical.resolve(words, idf).where(F.col("factor") == 0.6).collect()}
    want = {}
    for w in asked:
        near = [(0 if len(t) > 1000 else distance(w, t), t) for t in [*tokens, huge] if abs(len(t) - len(w)) <= 2 and len(w) >= 4]
        near = [x for x in near if x[0] <= (1 if len(w) <= 6 else 2)]
        if near and len(w) < 1000:
            want[w] = min(near)[1]
    assert {w: t for w, t in found.items() if len(w) < 1000} == want and want
    assert sum(len(w) >= 1000 for w in found) == 2  # one and two edits, not three
