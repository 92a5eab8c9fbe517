"""Text functions on hand-checked examples."""

import pytest
from pyspark.sql import functions as F

from matchlake.functions import text as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [("Ёж и Chardonnay", "еж и chardonnay"), (None, ""), ("  ", ""), ("A-1, б2!", "a 1 б2")])
def test_normalize(spark, value, want):
    assert one(spark, X.normalize(F.lit(value).cast("string"))) == want


def test_raw_words_repair_digits_and_cut_runs(spark):
    assert one(spark, X.raw_words(F.lit("УРОЖАЙ 2о24"))) == ["урожай", "2024"]
    assert one(spark, X.raw_words(F.lit("ПиноНуар abc12"))) == ["пино", "нуар", "abc", "12"]
    assert one(spark, X.raw_words(F.lit(None).cast("string"))) == []


def test_raw_words_fold_greek_and_cut_before_case_goes(spark):
    assert one(spark, X.raw_words(X.nfkc_cased(F.lit("ЧёрноеBrut2022")))) == ["черное", "brut", "2022"]
    assert one(spark, X.raw_words(X.nfkc_cased(F.lit("ΚΡΑCΗΟΕ ＡＢ")))) == ["краcное", "ab"]
    assert one(spark, X.raw_words(F.lit("Weiß"))) == ["weiss"]


@pytest.mark.parametrize("word, want", [("cabernet", {"cabernet", "каберне", "kaberne"}), ("brut", set()), ("брют", set()), ("ab", set()), ("7", set()), ("12", {"12"}), ("2022", {"2022"})])
def test_variants_of_terms_styles_and_digits(spark, word, want):
    assert set(one(spark, X.variants(F.lit(word)))) == want


def test_styles_of_folded_words(spark):
    assert one(spark, X.style(F.lit("CYXOE KPACHOE"), "sweetness")) == "dry"
    assert one(spark, X.style(F.lit("CYXOE KPACHOE"), "colour")) == "red"
    assert one(spark, X.style(F.lit("полусухое белое"), "sweetness")) == "semi_dry"
    assert one(spark, X.style(F.lit("Extra Brut rosé"), "sweetness")) == "extra_brut"
    assert one(spark, X.style(F.lit("nothing"), "colour")) is None


@pytest.mark.parametrize("value, want", [("ii", "2"), ("xiv", "14"), ("xcix", "99"), ("cl", "150"), ("i", None), ("abc", None), ("", None), ("iiii", None)])
def test_roman(spark, value, want):
    assert one(spark, X.roman(F.lit(value))) == want


def test_variants(spark):
    assert "шардоне" in one(spark, X.variants(F.lit("chardonnay")))
    assert one(spark, X.variants(F.lit("сухое"))) == []
    assert one(spark, X.variants(F.lit("вино"))) == ["vino"] or "вино" not in one(spark, X.variants(F.lit("вино")))
    assert "mertsayuschiy" in one(spark, X.variants(F.lit("мерцающий")))


def test_deletes_and_distance(spark):
    assert set(one(spark, X.deletes(F.lit("abc"), 1))) == {"abc", "bc", "ac", "ab"}
    assert set(one(spark, X.deletes(F.lit("abc"), 2))) == {"abc", "bc", "ac", "ab", "a", "b", "c"}
    assert one(spark, X.within(F.lit("kitten"), F.lit("sitting"), 2)) == 3
    assert one(spark, X.within(F.lit("красностоб"), F.lit("красностоп"), 2)) == 1


def test_numbers_and_lists(spark):
    assert one(spark, X.optional_number(F.lit("4,2"))) == 4.2 and one(spark, X.optional_number(F.lit("x"))) is None
    assert one(spark, X.first_number(F.lit("12,5 % об."))) == 12.5 and one(spark, X.first_number(F.lit(None))) is None
    assert one(spark, X.split_list(F.lit(" a, b;;c "))) == ["a", "b", "c"]
    assert one(spark, X.json_list(F.lit('["x","y"]'))) == ["x", "y"] and one(spark, X.json_list(F.lit("x; y"))) == ["x", "y"]


def test_sequence_ratio_is_not_symmetric_and_takes_nulls(spark):
    import difflib

    rows = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "a"), ("", "")], "a string, b string")
    found = [r["x"] for r in rows.select(X.sequence_ratio("a", "b").alias("x")).collect()]
    assert found == [difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in [("tide", "diet"), ("diet", "tide"), (None, "a"), ("", "")]]


def test_image_types(spark):
    cases = {
        b"\xff\xd8\xff\xe0": "image/jpeg", b"\x89PNG\r\n\x1a\n..": "image/png", b"RIFF1234WEBPVP8 ": "image/webp", b"\0\0\0\x18ftypheic\0\0\0\0mif1": "image/heic",
        b"\0\0\0\x18ftypxxxx\0\0\0\0avif": "image/avif", b"%PDF-1.4": None, b"": None,
    }
    rows = spark.createDataFrame([(bytearray(k),) for k in cases], "data binary")
    assert [r["x"] for r in rows.select(X.mime_type(F.col("data")).alias("x")).collect()] == list(cases.values())
    assert one(spark, X.upload_allowed(F.lit("Image/PNG; q=1"), F.lit(b"??"))) and not one(spark, X.upload_allowed(F.lit(None).cast("string"), F.lit(b"??")))


def test_small_formats(spark):
    assert [one(spark, X.plural(F.lit(n), "оценка", "оценки", "оценок")) for n in (1, 3, 5, 11, 21, 0)] == ["1 оценка", "3 оценки", "5 оценок", "11 оценок", "21 оценка", ""]
    assert one(spark, X.image_url(F.lit(""), "https://x/y/", F.lit("blanc de blancs.webp"))) == "https://x/y/blanc%20de%20blancs.webp"
    assert one(spark, X.escape_html(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, X.nfkc(F.lit("ﬁＡ"))) == "fia"
    assert [one(spark, X.relative_time(F.lit(m))) for m in (0, 5, 130, 3000)] == ["now", "5 min", "2 h", "2 d"]
