"""The pipeline's stages on a small corpus, and the registered queries."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchlake.llm import queries, simhash

pytest.importorskip("public_tokenizers")
WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "s", "er", "tion"]) for _ in range(n))
    docs = [(i, "\n".join(text(rng.randint(8, 30)) for _ in range(4)), rng.choice(["en", "en", "fr"])) for i in range(80)]
    docs = [(i, t if g == "en" else t.replace("t", "é"), g) for i, t, g in docs]
    docs += [(80, docs[0][1], "en"), (81, docs[3][1] + "\n" + docs[5][1].split("\n")[0], "en"), (82, "12345 !!!", "en"), (83, None, "en"), (84, "", "fr")]
    bad = [(90 + i, text(30) + " idiot moron idiot", "en") for i in range(20)]
    docs += bad + [(120 + i, text(20).replace(" ", "*** "), "en") for i in range(12)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, t, g in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(90 + i, 1, 1) for i in range(12)] + [(120 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs


def test_stages(spark, corpus, tmp_path):
    folder, docs = corpus
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, folder).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "encode":
            assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = [r["doc_id"] for r in rows.collect()]
    assert set(seen["language"]) == {i for i, _, _ in docs} - {82, 83, 84}
    assert 80 not in seen["line_dedup"] and set(range(80)) <= set(seen["line_dedup"])
    assert len(seen["near_dedup"]) == len(set(seen["near_dedup"]))
    clean = [i for i in range(40) if i in seen["near_dedup"]]
    assert set(clean) <= set(seen["mixture"]) and sum(90 <= i < 120 for i in seen["mixture"]) < 12
    assert sorted(seen["encode"]) == sorted(seen["mixture"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mixture", "encode"]


def test_run_equals_its_stages(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("copies", "__id", "__gone", "th"):  # clashing names
        docs = docs.withColumn(name, F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    want = sorted(map(tuple, docs.collect()))
    assert want == sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) and len(want) > 60


def test_stages_take_clashing_columns_and_nothing(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("copies", "__id", "__gone", "th", "rep", "fp", "component_id", "lang_pred", "removed", "kept", "id", "word"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() > 30
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_near_dedup_of_repeated_rows(spark):
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (3, "q r s t u v", "en", "s", 1), (None, "no id", "en", "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [0, 1, 3]


def test_near_dedup_is_that_of_exact_jaccard(spark):
    # one word of 100 replaced: five-word Jaccard 0.90, found by 0.98; 12 words apart: under 0.8
    rng = random.Random(5)
    rows = []
    for i in range(20):
        base = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(100)]
        near, far = list(base), list(base)
        near[10 + i] = "changed"
        for at in range(5, 100, 12):
            far[at] = "other"
        rows += [(i, " ".join(base)), (100 + i, " ".join(near[:50]) + "\n" + " ".join(near[50:])), (200 + i, " ".join(far))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()}
    assert kept >= {*range(20), *range(200, 220)} and len(kept) <= 42


@pytest.mark.parametrize("few", [2, 64])
def test_near_groups_are_those_of_all_pairs_without_comparing_all(spark, monkeypatch, few):
    # families of changed copies, and a passage that unlike texts share
    rng = random.Random(3)
    text = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(n)]
    rows, passage = [], text(12)
    for _ in range(6):
        base = text(rng.randint(30, 90))
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = rng.choice(["É1", "new"])
            rows.append(" ".join(own))
            base = own if rng.random() < 0.3 else base
    rows += [" ".join(passage + text(40)) for _ in range(12)] + ["one two", "ONE two", "one  É1", "one é1"]
    rows = list(enumerate(rows))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, prints = [shingles(t) for _, t in rows], [simhash.fingerprint(t, 5) for _, t in rows]
    first = {f: prints.index(f) for f in prints}
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, _ in rows:
        for j in range(i):
            x, y = first[prints[i]], first[prints[j]]
            near = (prints[i] ^ prints[j]).bit_count() <= 12 and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9
            if near or x == y:
                a, b = sorted((root(i), root(j)))
                above[b] = a
    monkeypatch.setattr(simhash, "FEW", few, raising=False)
    monkeypatch.setattr(simhash, "links", lambda *_: pytest.fail("compares fingerprints in all their pairs"))
    found = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=5, radius=12, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: root(i) for i, _ in rows}
    assert 6 < len({root(i) for i, _ in rows}) < 70


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        "op2_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op5_simhash": ["doc_id", "fingerprint", "component_id"],
        "op6_language": ["doc_id", "held_out", "lang_pred", "score"],
    }
    for name, columns in want.items():
        found = queries.QUERIES[name](spark, sf)
        assert found.columns[: len(columns)] == columns and found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert found.where(~F.col("score").between(0, 1)).count() == 0
