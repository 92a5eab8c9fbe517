"""Text operators against brute force, round trips and held-out accuracy, on small tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from matchlake.llm import gru, langid, lines, mixing, paragraphs, queries, sentencepiece, simhash, suffixes

sp = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "s", "ed"]) for _ in range(n))


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


ODD = [(700, None), (701, ""), (702, " \n\t "), (703, "x"), (704, "ж漢🙂é ▁ \u0000 end"), (None, "no id at all in this row"), (705, "word " * 4000), (705, "word " * 4000)]


# ---------------------------------------------------------------- op2


def test_encoding_is_the_librarys(spark):
    rng = random.Random(2)
    chars = "aabcde  ▁\n\t the ing é漢🙂⁇ж.,!?'<s>09"
    rows = [(i, "".join(rng.choice(chars) for _ in range(rng.randint(0, 200)))) for i in range(80)] + ODD
    path = tokenizers.path("piece_bpe_32k.model")
    own = sp.SentencePieceProcessor(model_file=path)
    found = sentencepiece.encode_decode(table(spark, rows).withColumn("ids", F.lit(1)), path).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in found) == Counter((i, tuple(own.encode(t or "", add_eos=True)), own.decode(own.encode(t or ""))) for i, t in rows)
    digest = queries.piece_digests(sentencepiece.encode_decode(table(spark, rows[:1]), path)).first()
    assert digest["ids_sha256"] == hashlib.sha256(" ".join(map(str, own.encode(rows[0][1], add_eos=True))).encode()).hexdigest()


def test_encoding_of_nothing(spark):
    assert sentencepiece.encode_decode(table(spark, []), tokenizers.path("piece_bpe_32k.model")).count() == 0


# ---------------------------------------------------------------- op5


def plain_fingerprint(text, words):
    own = "".join(c.lower() if c.isascii() else c for c in text or "")
    own = [w for w in __import__("re").split("[\x20\x09-\x0d]+", own) if w]
    shingles = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(40)]
    for i in range(40, 70):
        words = rng.choice(rows)[1].split() or ["a"]
        words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    rows += [(200 + i, "the same text again and again here") for i in range(5)] + ODD
    for radius in (2, 12):
        prints = {i: plain_fingerprint(t, 3) for i, t in rows}
        above = {i: i for i in prints if i is not None}

        def root(i, above=above):
            while above[i] != i:
                i = above[i]
            return i

        for a, b in itertools.combinations(sorted(above), 2):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = sorted((root(a), root(b)))
                above[y] = x
        found = simhash.simhash_groups(table(spark, rows).withColumn("fp", F.lit(0)).withColumn("rep", F.lit(0)), radius=radius).collect()
        assert len(found) == len(rows)
        for r in found:
            assert r["fp"] % (1 << 64) == prints[r["doc_id"]]
            if r["doc_id"] is not None:
                assert r["component_id"] == root(r["doc_id"])


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_simhash_links_for_each_tiling(spark, parts, monkeypatch):
    rng = random.Random(parts)
    fps = {rng.getrandbits(64) for _ in range(60)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:30]}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "parts_for", lambda n, **_: parts)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(rows, len(fps), 2).collect()}
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 2}

    def classes(pairs):
        own = list(range(len(fps)))
        for i, j in pairs:
            own = [own[min(i, j)] if x == own[max(i, j)] else x for x in own]
        return [own.index(x) for x in own]

    assert len(near) >= 25 and found <= near and classes(found) == classes(near)


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(table(spark, [])).count() == 0


# ---------------------------------------------------------------- op6


def test_language_of_held_out_texts(spark):
    rng = random.Random(6)
    stock = {"xx": "lorem ipsum dolor sit amet consectetur elit".split(), "yy": "bonjour monde grand petit chat chien oiseau".split(), "zz": "der die das hund katze vogel welt".split()}
    rows = [(i, " ".join(rng.choice(stock[g]) for _ in range(rng.randint(3, 40))), g) for i in range(150) for g in [rng.choice(list(stock))]]
    fit = table(spark, rows[:100] + [(900, None, "xx"), (901, "lorem", None), (902, "", "yy")], "doc_id long, text string, lang string")
    own = langid.fit(fit)
    found = {r["doc_id"]: r for r in langid.predict(table(spark, [r[:2] for r in rows[100:]] + ODD), own).collect()}
    assert sum(found[i]["lang_pred"] == g for i, _, g in rows[100:]) == 50
    for i in (700, 701, 702):
        assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.with_language(fit, own).where("lang_pred = 'xx'").count() > 0


def test_language_without_labels(spark):
    own = langid.fit(table(spark, [], "doc_id long, text string, lang string"))
    assert langid.predict(table(spark, [(1, "abc")]), own).first()["lang_pred"] == "und"


def test_out_of_place_distance():
    codes, counts = langid.grams("ab ab b")
    top = langid.ranked(codes, counts, 5)
    assert len(top) == 5 and (counts[codes == top[0]] == counts.max()).all()
    own = langid.Profiles({"p": top, "q": top[::-1].copy()}, 5)
    assert own.predict("ab ab b")[0] == "p"


# ---------------------------------------------------------------- op7


def words_of(line):
    return __import__("re").sub("[\t\r]", " ", line.lower()).split(" ")


def test_line_dedup_keeps_the_first_of_equal_lines(spark):
    rng = random.Random(7)
    shared = [prose(rng, 12) for _ in range(6)]
    rows = []
    for i in range(30):
        own = [prose(rng, rng.randint(5, 20)) for _ in range(2)] + rng.sample(shared, 3) + ["Of.", "a    b", "of  the"]
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += ODD
    docs = table(spark, rows)
    for name in ("pos", "h1", "__id", "__gone", "_line_id", "removed", "own"):
        docs = docs.withColumn(name, F.lit(1))
    found = {r["doc_id"]: r for r in lines.dedup_lines(docs, similarity=1.0).collect()}
    assert len(found) == len({i for i, _ in rows}) and found[0]["_line_id"] == found[0]["__gone"] == 1
    seen = set()
    for i, text in sorted(((i, t) for i, t in dict(rows).items() if i is not None), key=lambda r: r[0]):
        kept = []
        for line in (text or "").split("\n"):
            key = tuple(w for w in words_of(line) if w)
            if len(key) >= 5 and key in seen:
                continue
            seen.add(key)
            kept.append(line)
        assert found[i]["kept"] == (None if text is None else "\n".join(kept)), i


def test_line_dedup_of_repeated_rows(spark):
    # rows equal in id and text are one document; rows that share an id only are two
    text = "one two three four five\nsix seven eight nine ten"
    rows = [(1, text), (1, text), (1, text + "\nmore"), (2, text), (None, None)]
    found = [(r["doc_id"], list(r["removed"])) for r in lines.dedup_lines(table(spark, rows)).collect()]
    first = [x for x in found if x[0] == 1]
    assert sorted(map(str, first)) in (["(1, [0, 1])", "(1, [])", "(1, [])"], ["(1, [0, 1])", "(1, [0, 1])", "(1, [])"])
    assert (2, [0, 1]) in found and (None, []) in found and len(found) == 5


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(["the same line all over again"] * 100_000)
    found = sorted((r["doc_id"], len(r["removed"]), r["kept"]) for r in lines.dedup_lines(table(spark, [(1, text), (2, text + "\nend")])).collect())
    assert found == [(1, 99_999, "the same line all over again"), (2, 100_000, "end")]
    text = "\n".join(["the same line all over again"] + [f"line no {i}" for i in range(50_000)])
    found = sorted((r["doc_id"], len(r["removed"]), len(r["kept"])) for r in lines.dedup_lines(table(spark, [(1, text), (2, text)])).collect())
    assert found == [(1, 0, len(text)), (2, 1, len(text) - 29)]


def test_line_dedup_joins_near_lines_in_chains(spark):
    rng = random.Random(8)
    long = prose(rng, 400).split()
    variants = []
    for i in range(40):
        own = list(long)
        own[rng.randrange(400)] = "changed"
        variants.append((i, " ".join(own)))
    other = [(100 + i, prose(rng, 300)) for i in range(10)]
    found = lines.dedup_lines(table(spark, variants + other)).collect()
    assert {r["doc_id"] for r in found if r["removed"]} == set(range(1, 40))
    _, groups = lines.line_groups(table(spark, variants + other))
    assert groups.count() == len({t for _, t in variants}) and groups.select("component").distinct().count() == 1


def test_line_dedup_verifies_edit_similarity(spark):
    # equal words, so equal blocks, in another order: not a near copy
    a = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (2, " ".join(reversed(a)))]
    assert [list(r["removed"]) for r in lines.dedup_lines(table(spark, rows)).orderBy("doc_id").collect()] == [[], []]


def test_recall_of_line_pairs(spark):
    # pairs by themselves, at an edit similarity of just 0.8, over a vocabulary of Zipf's kind
    rng = random.Random(21)
    stock = [f"w{i}" for i in range(20_000)]
    weights = [1 / (i + 3) for i in range(20_000)]
    rows = []
    for i in range(400):
        n = rng.choice([10, 15, 20, 30, 50])
        base = rng.choices(stock, weights, k=n)
        own = list(base)
        for at in rng.sample(range(n), n // 5):
            own[at] = f"new{i}.{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(own))]
    gone = {r["doc_id"] for r in lines.dedup_lines(table(spark, rows)).collect() if r["removed"]}
    assert len(gone & {2 * i + 1 for i in range(400)}) >= 0.94 * 400
    assert not gone & {2 * i for i in range(400)}


def words_apart(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_line_links_are_those_of_all_pairs(spark, monkeypatch):
    # short lines with replaced, dropped and added words
    monkeypatch.setattr(lines, "SAMPLE", 1)
    rng = random.Random(12)
    rows = []
    for n in [5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 30, 30]:
        base = [rng.choice(WORDS) + rng.choice(["", "er", "ing", "ed"]) for _ in range(n)]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.randint(1, n // 5)):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1, 1])] = rng.choice([["new"], ["odd"], ["x", "y"][:1], []])
            rows.append(" ".join(own + ["end"] * max(0, 5 - len(own))))
    rows = sorted(set(rows))
    above = list(range(len(rows)))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    linked = 0
    for i, x in enumerate(rows):
        for j in range(i):
            a, b = x.split(), rows[j].split()
            if words_apart(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9):
                linked += 1
                u, v = root(i), root(j)
                above[max(u, v)] = min(u, v)
    found = lines.dedup_lines(table(spark, list(enumerate(rows)))).collect()
    assert linked > 50
    assert {r["doc_id"] for r in found if r["removed"]} == {i for i in range(len(rows)) if root(i) != i}


def test_common_words_are_counted_over_all_texts(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(f"often {prose(rng, 3)} x{i}.{n} y{i}.{n}" for n in range(20))) for i in range(60)]
    texts = lines._texts(table(spark, rows), "doc_id", "text")
    h = spark.range(1).select(F.xxhash64(F.lit("often"))).first()[0]
    assert lines.common_words(texts)[0] == h % lines.WORD_CLASSES


def test_links_of_large_blocks_and_each_pair_once(spark, monkeypatch):
    # families that go on changing, in blocks of which all are large: their pairs are looked at once and none is left out
    monkeypatch.setattr(lines, "FEW", 1)
    rng = random.Random(9)
    rows = []
    for _ in range(5):
        own = [f"{w}{rng.randrange(9)}" for w in prose(rng, 20).split()]
        for _ in range(12):
            own = list(own)
            own[rng.randrange(20)] = f"new{rng.randrange(99)}"
            rows.append(" ".join(own))
    seen, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *a: seen.append(pairs) or verified(pairs, *a))
    found = lines.dedup_lines(table(spark, list(enumerate(rows)))).collect()
    assert [r["doc_id"] for r in found if not r["removed"]] == [0, 12, 24, 36, 48]
    assert len(seen) == 2 and seen[1].count() == seen[1].distinct().count() > 0
    assert "array_intersect" in seen[1]._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]


def test_only_near_pairs_leave_the_join_of_a_large_block(spark, monkeypatch):
    # lines that agree in most of their first words but are not near, in blocks of which all are large
    monkeypatch.setattr(lines, "FEW", 1)
    rng = random.Random(5)
    base = [f"stem{i}" for i in range(40)]
    rows = [" ".join(w if rng.random() < 0.7 else f"new{rng.randrange(9999)}" for w in base) for _ in range(30)]
    seen, verified = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, *a: seen.append(verified(pairs, *a)) or seen[-1])
    found = lines.dedup_lines(table(spark, list(enumerate(rows)))).collect()
    assert not any(r["removed"] for r in found)
    joined = seen[1]._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
    assert "levenshtein" in joined and seen[1].count() == 0


def test_keyed_lines_are_the_block_keys(spark):
    rng = random.Random(6)
    rows = [(i, n, sorted(rng.sample(range(10**6), min(n, 12, rng.randint(1, 20))))) for i, n in enumerate([*range(5, 40)] * 3)]
    own = spark.createDataFrame(rows, "id long, n int, least array<int>")
    want = own.select("id", F.explode(lines.block_keys()).alias("key"))
    assert sorted(map(tuple, lines.keyed_lines(own, "id").select("id", "key").collect())) == sorted(map(tuple, want.collect()))


def test_words_are_counted_if_blocks_are_crowded(spark, monkeypatch):
    counted, count = [], lines.common_words
    monkeypatch.setattr(lines, "common_words", lambda texts: counted.append(1) or count(texts))
    rng = random.Random(7)
    apart = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(60)]
    assert not any(r["removed"] for r in lines.dedup_lines(table(spark, apart)).collect()) and not counted
    often = [f"often{i}" for i in range(30)]
    rows = [(i, " ".join(rng.sample(own := [*often, *(f"w{rng.randrange(10**6)}" for _ in range(4))], len(own)))) for i in range(60)]
    assert not any(r["removed"] for r in lines.dedup_lines(table(spark, rows)).collect()) and counted


def test_line_dedup_of_nothing(spark):
    assert lines.dedup_lines(table(spark, [])).count() == 0


# ---------------------------------------------------------------- op3


def test_paragraphs_and_passages(spark):
    rng = random.Random(3)
    para, passage = prose(rng, 60), prose(rng, 60)
    near = para.split()
    near[7] = "changed"
    rows = [(1, prose(rng, 30) + "\n" + para), (2, " ".join(near) + "\n" + prose(rng, 40)), (3, prose(rng, 25) + " " + passage + " " + prose(rng, 25)), (4, prose(rng, 10) + "\n" + prose(rng, 33) + " " + passage), (5, prose(rng, 200)), *ODD]
    docs = table(spark, rows)
    for name in ("start", "th", "bucket", "target", "component_id", "shared"):
        docs = docs.withColumn(name, F.lit(0))
    found = {r["doc_id"]: r for r in paragraphs.dedup_paragraphs(docs).collect()}
    assert set(found) == {i for i, _ in rows}
    for i in (5, 700, 701, 702, 703, 704, None):
        assert not found[i]["shared"] and not found[i]["n_removed"] and found[i]["component_id"] == i
    assert found[3]["component_id"] == found[4]["component_id"] == 3
    assert not found[1]["removed"] and found[2]["component_id"] == 1 and found[2]["n_removed"] >= len(" ".join(near))
    start = rows[3][1].encode().index(passage.encode())
    span = found[4]["removed"][0]
    assert start <= span["start"] < span["stop"] <= start + len(passage.encode()) and not found[3]["removed"]


def test_passages_are_those_of_equal_bytes_and_classes_are_closed(spark):
    rng = random.Random(31)
    shared = [prose(rng, 60) for _ in range(5)]
    rows = [(i, " ".join([prose(rng, 20), *[x + " " + prose(rng, 15) for x in rng.sample(shared, rng.randint(0, 2))]])) for i in range(40)]
    own = {}
    for i, t in rows:
        for a, b, _, _ in zip(*paragraphs.passages(t.encode().lower())):
            own.setdefault(t.encode().lower()[a:b], []).append((i, a, b))
    twice = [sorted(x) for x in own.values() if len(x) > 1]
    source = paragraphs._source(table(spark, rows), "doc_id", "text")
    found = {(r["doc_id"], r["start"], r["stop"], r["first"]["doc_id"], r["first"]["start"]) for r in paragraphs.passage_groups(source).collect()}
    assert twice and found == {(i, a, b, x[0][0], x[0][1]) for x in twice for i, a, b in x}
    above = {i: i for i, _ in rows}

    def root(i):
        return i if above[i] == i else root(above[i])

    for x in twice:
        for i, _, _ in x:
            a, b = sorted((root(i), root(x[0][0])))
            above[b] = a
    assert {r["doc_id"]: r["component_id"] for r in paragraphs.dedup_paragraphs(table(spark, rows)).collect()} == {i: root(i) for i in above}


def test_paragraph_pairs_are_those_of_exact_jaccard(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        base = prose(rng, 50).split()
        for j in range(4):
            own = list(base)
            for _ in range(j):
                own[rng.randrange(len(own))] = rng.choice(WORDS) + "x"
            rows.append((4 * i + j, " ".join(own)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(46)} for i, t in rows}
    above = {i: i for i, _ in rows}

    def root(i):
        return i if above[i] == i else root(above[i])

    for a, b in itertools.combinations(above, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            above[y] = x
    source = paragraphs._source(table(spark, rows), "doc_id", "text")
    found = {r["doc_id"]: r["first"]["doc_id"] for r in paragraphs.paragraph_groups(source, 8, 0.8).collect()}
    groups = Counter(map(root, above))
    assert {i: c for i, c in found.items() if c != i or groups[c] > 1} == {i: root(i) for i in above if groups[root(i)] > 1}


def test_near_pairs_are_those_of_exact_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 40)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(20, 40)), rng.integers(0, 1 << 60, rng.integers(0, 6))]) for _ in range(60)]
    near = lambda a, b: len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b))
    i, j = paragraphs.near_pairs(sets[:25], sets[25:], 0.6)
    assert set(zip(i, j)) == {(x, y) for x in range(25) for y in range(35) if near(sets[x], sets[25 + y])}
    i, j = paragraphs.near_pairs(sets, sets, 0.6)
    assert {(x, y) for x, y in zip(i, j) if x != y} == {(x, y) for x in range(60) for y in range(60) if x != y and near(sets[x], sets[y])}


def test_bands_reach_the_recall():
    n = paragraphs.bands_for(0.8, 3, 0.995)
    assert 1 - (1 - 0.8**3) ** n >= 0.995 > 1 - (1 - 0.8**3) ** (n - 1)


def test_paragraphs_of_nothing(spark):
    assert paragraphs.dedup_paragraphs(table(spark, [])).count() == 0


# ---------------------------------------------------------------- op10


def covered(docs, width):
    first = {}
    for d, t in sorted(docs):
        for p in range(len(t) - width + 1):
            first.setdefault(t[p : p + width], (d, p))
    out = {}
    for d, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if first[t[p : p + width]] < (d, p):
                gone[p : p + width] = b"\1" * width
        out[d] = bytes(gone)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_suffix_dedup_is_that_of_all_windows(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(90, 500))) for _ in range(4)]
    docs = []
    for d in range(35):
        text = ""
        for _ in range(rng.randint(0, 4)):
            own, k = rng.choice(base), rng.random()
            at = rng.randint(0, len(own))
            text += own if k < 0.2 else own[at : at + rng.randint(0, 300)] if k < 0.6 else "aaaaaaaa" * rng.randint(0, 40) if k < 0.7 else "".join(rng.choice("xyz") for _ in range(99))
        docs.append((d, text))
    docs[9] = (9, docs[3][1])
    want = covered([(d, t.encode()) for d, t in docs], 100)
    found = {r["doc_id"]: r for r in suffixes.dedup_substrings(table(spark, [*docs, (None, None), (50, "")]).withColumn("bucket", F.lit(1))).collect()}
    for d, t in docs:
        gone = bytearray(len(t.encode()))
        for s in found[d]["spans"]:
            gone[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
        assert bytes(gone) == want[d]
        assert bytes(found[d]["kept"]) == bytes(c for c, g in zip(t.encode(), gone) if not g)
    assert found[None]["n_bytes"] == found[50]["n_bytes"] == 0


def test_suffix_dedup_of_a_long_text_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(299_999))
    text += "a" if text[999] != "a" else "b"
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 16)
    rows = [(1, text + text[1000:2000]), (2, text[5000:5300]), (2, text[5000:5300]), (3, "y" * 99)]
    found = sorted((r["doc_id"], [(s["start"], s["end"]) for s in r["spans"]]) for r in suffixes.dedup_substrings(table(spark, rows)).collect())
    assert found == [(1, [(300_000, 301_000)]), (2, [(0, 300)]), (2, [(0, 300)]), (3, [])]


def test_deep_shallow_order():
    import numpy as np

    rng = random.Random(0)
    for _ in range(50):
        own = [bytes(rng.choice(b"ab") for _ in range(24)) for _ in range(rng.randint(1, 50))]
        order = suffixes.deep_shallow_order(np.array([list(x) for x in own], np.uint8), 8)
        assert [own[i] for i in order] == sorted(own) and sorted(order) == list(range(len(own)))


def test_suffix_dedup_of_nothing(spark):
    assert suffixes.dedup_substrings(table(spark, [])).count() == 0


# ---------------------------------------------------------------- op9


def test_unigram_base_and_model(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(0, 80))) for i in range(120)] + [(130, "Unseen ZZZ the"), *ODD]
    training = F.col("doc_id") < 90
    learn = Counter()
    for i, t in rows:
        if i is not None and i < 90:
            learn.update(gru.tokens(t))
    total, distinct = sum(learn.values()), len(learn)
    for hand in (gru.AT_HAND, 10):  # counts at hand, and counts that are joined
        monkeypatch.setattr(gru, "AT_HAND", hand)
        found = gru.score_documents(table(spark, rows).withColumn("word", F.lit("w")), training).collect()
        assert len(found) == len(rows)
        texts = {}
        for i, t in rows:
            texts[i] = gru.tokens(t)
        for r in found:
            own = texts[r["doc_id"]]
            assert r["n_tokens"] == len(own) and r["train_tokens"] == total
            assert r["n_known"] == sum(learn[w] > 0 for w in own)
            assert math.isclose(r["base_score"], sum(math.log10((learn[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), rel_tol=1e-9)
            assert r["score"] < 0


def test_model_is_a_distribution_and_learns():
    import numpy as np

    counts = np.array([20, 30, 30, 5, 4])
    model = gru.GatedLM(counts, np.array([3.0] * gru.TAILS))
    texts = [np.array([1, 2, 1, 2, 1, 2, 1, 2, 0], np.int32)] * 60
    h = np.random.default_rng(0).standard_normal((1, gru.HIDDEN)).astype(np.float32)
    ids = np.r_[np.arange(5), gru.COMMON + np.arange(gru.TAILS)]
    before = model.score(texts[:1])[0]
    model.train(texts, epochs=40)
    assert math.isclose(np.exp(model.log_probs(np.repeat(h, len(ids), 0), ids)).sum(), 1, rel_tol=1e-5)
    after = model.score(texts[:1])[0]
    assert after > before + 2
    # texts in lanes and windows score what they score alone
    mixed = [np.array([1, 2, 3, 0], np.int32), np.array([0], np.int32), np.array([2] * 50 + [0], np.int32), gru.COMMON + np.array([3, 4], np.int32)]
    assert np.allclose(model.score(mixed, lanes=2, window=3), [model.score([t])[0] for t in mixed], atol=1e-4)


def test_gradient_is_that_of_the_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    model = gru.GatedLM(np.array([5, 9, 7, 3]), np.array([2.0] * gru.TAILS))
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
        if k in ("Wc", "U"):
            model.p[k] += rng.standard_normal(model.p[k].shape) * 0.3
    given, target = np.array([[0, 1, 2, 0, 3]]), np.array([[1, 2, 0, 3, gru.COMMON + 2]])
    h = rng.standard_normal((1, gru.HIDDEN))

    def loss():
        own, states = np.zeros((1, gru.HIDDEN)) if given[0, 0] == 0 else h, []
        for t in range(5):
            if given[0, t] == 0:
                own = np.zeros((1, gru.HIDDEN))
            own = model._step(model.p["E"][given[:, t]] @ model.p["Wx"] + model.p["b"], own)[4]
            states.append(own)
        return -model.log_probs(np.concatenate(states), target[0]).mean()

    g, _ = model._gradient(given, target, h)
    for k, at in (("Wh", (3, 40)), ("Wx", (2, 5)), ("E", (2, 4)), ("Wc", (1, gru.CLASSES + 2)), ("U", (0, 2, 6)), ("b", (70,)), ("bu", (0, 1))):
        keep, step = model.p[k][at], 1e-5
        model.p[k][at] = keep + step
        up = loss()
        model.p[k][at] = keep - step
        down = loss()
        model.p[k][at] = keep
        assert math.isclose((up - down) / (2 * step), g[k][at], rel_tol=1e-3, abs_tol=1e-7), k


def test_words_of_a_batch_are_those_of_each_text():
    # whole batches are split and looked up without a Python object for each word
    import numpy as np
    import pyarrow as pa

    texts = ["x", None, "", "  The\tthe ", "a\x0bB\x1cc\u00a0d \u2003 É\x00 ß", " \r\n ", "a a é a", "z" * 5000]
    column = pa.array(texts).slice(1)
    hand = [gru.END, b"the", b"a"]
    ids = {w: i for i, w in enumerate(hand)}
    words, owner, sizes = gru.split_words(column)
    own = [gru.tokens(t) for t in texts[1:]]
    assert [bytes(w) for w in words.to_pylist()] == [w for t in own for w in t[:-1]] and sizes.tolist() == [len(t) for t in own]
    found = gru.sequences(words, owner, sizes, gru.places_in(words, pa.array(hand, pa.binary())), np.array([0, 1, 2, 0], np.int32))
    assert [x.tolist() for x in found] == [[ids.get(w, gru.COMMON + gru.tail_of(w)) for w in t] for t in own]
    empty = gru.split_words(pa.array([None], pa.string()))
    assert [x.tolist() for x in gru.sequences(*empty, gru.places_in(empty[0], pa.array(hand, pa.binary())), np.zeros(4, np.int32))] == [[0]]


def test_wide_weights_keep_their_own_peaks():
    # logits further apart than exp bears at one peak for all rows; each row is still a distribution
    import numpy as np

    rng = np.random.default_rng(2)
    model = gru.GatedLM(np.array([5, 9, 7, 3]), np.array([2.0] * gru.TAILS))
    for k in ("Wc", "U"):
        model.p[k] = (rng.standard_normal(model.p[k].shape) * 60).astype(np.float32)
    h = np.tanh(rng.standard_normal((50, gru.HIDDEN))).astype(np.float32)
    ids = np.r_[np.arange(4), gru.COMMON + np.arange(gru.TAILS)]
    logs = np.array([model.log_probs(np.repeat(x[None], len(ids), 0), ids) for x in h])
    assert np.isfinite(logs).all() and np.allclose(np.exp(logs).sum(axis=1), 1, rtol=1e-4)
    assert np.allclose(model.log_probs(h, np.resize(ids, 50)), logs[np.arange(50), np.arange(50) % len(ids)], rtol=1e-4, atol=1e-3)
    given = np.resize(np.arange(4), (50, 8))
    assert all(np.isfinite(x).all() for x in model._gradient(given, np.roll(given, -1, axis=1), h)[0].values())


def test_scores_are_the_models_probabilities(spark, monkeypatch):
    # token by token in plain numpy, from the weights that training gave; held-out texts score above the base
    import numpy as np

    rng = random.Random(19)
    rows = [(i, " ".join(x for _ in range(rng.randint(1, 40)) for x in rng.choice([("of", "the", "end"), ("it", "was", "so"), (f"rare{rng.randrange(300)}",)]))) for i in range(200)] + ODD
    kept, train = [], gru.train_on

    def keep(learn, model, ids, total, *more):
        before = model.flat()
        train(learn, model, ids, total, *more)
        kept.append((model, ids, np.abs(model.flat() - before).max()))

    monkeypatch.setattr(gru, "train_on", keep)
    training = F.col("doc_id") < 150
    found = gru.score_documents(table(spark, rows), training).collect()
    model, ids, moved = kept[0]
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    counts = Counter(w for i, t in rows if i is not None and i < 150 for w in gru.tokens(t))
    mass = np.full(gru.TAILS, 0.5)
    for w, n in counts.items():
        if ids.get(w, gru.COMMON) >= gru.COMMON:
            mass[gru.tail_of(w)] += n + 0.5

    def plain(text):
        h, before, total = np.zeros(gru.HIDDEN), 0, 0.0
        for w in gru.tokens(text):
            gx, gh = p["E"][before] @ p["Wx"] + p["b"], h @ p["Wh"]
            z, r = np.split(1 / (1 + np.exp(-(gx + gh)[: 2 * gru.HIDDEN])), 2)
            n = np.tanh(gx[2 * gru.HIDDEN :] + r * gh[2 * gru.HIDDEN :])
            h = n + z * (h - n)
            own = ids.get(w, gru.COMMON + gru.tail_of(w))
            soft = np.exp(h @ p["Wc"] + p["bc"])
            if own < gru.COMMON:
                c, k = divmod(own, gru.CLASS_WORDS)
                words = np.exp(p["U"][c] @ h + p["bu"][c])
                total += math.log10(soft[c] / soft.sum() * words[k] / words.sum())
            else:
                c = own - gru.COMMON
                total += math.log10(soft[gru.CLASSES + c] / soft.sum() * (counts[w] + 0.5) / mass[c])
            before = own
        return total

    texts = {}
    for i, t in rows:
        texts[i] = plain(t) if i != 705 else None
    assert moved > 0.01
    for r in found:
        if r["doc_id"] != 705:
            assert math.isclose(r["score"], texts[r["doc_id"]], rel_tol=1e-4, abs_tol=1e-3)
    held = [r for r in found if r["doc_id"] is not None and 150 <= r["doc_id"] < 200]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_every_training_text_is_trained_on():
    assert {no % gru.SHARE for no in range(gru.ROUNDS)} == set(range(gru.SHARE))


def test_scores_without_training_rows(spark):
    found = gru.score_documents(table(spark, [(1, "a b"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    each = math.log10(1 / (1 + gru.TAILS))
    assert math.isclose(found[0]["score"], 3 * each, rel_tol=1e-5) and math.isclose(found[1]["score"], each, rel_tol=1e-5)
    assert gru.score_documents(table(spark, []), F.lit(True)).count() == 0


def test_short_first_words_lose_no_pair(spark):
    # first words by 15 bits: words of one line that agree in them do not count against a pair
    rng = random.Random(23)
    rows = []
    for _ in range(300):
        pool = [(rng.randrange(4) << 15) | rng.randrange(14) for _ in range(60)]  # many agree in 15 bits
        a, b = (sorted(dict.fromkeys(rng.sample(pool, 40)))[: rng.choice([5, 9, 12])] for _ in "ab")
        rows.append((rng.randint(5, 40), a, rng.randint(5, 40), b))
    pairs = spark.createDataFrame(rows, "n int, least array<int>, n_b int, least_b array<int>").withColumns({"near": lines._near(0.8), "wanted": F.size(F.array_intersect("least", "least_b"))})
    pairs = pairs.withColumns({c: lines._short(c) for c in ("least", "least_b")}).withColumn("short", lines._near(0.8)).collect()
    assert any(r["near"] for r in pairs) and all(r["short"] for r in pairs if r["near"])
    assert all(type(x) is int and 0 <= x < 1 << 15 for r in pairs for x in r["least"])


def test_first_words_of_repetitive_lines(spark):
    # the first different words, however often each is repeated, with and without common ones
    rng = random.Random(29)
    rows = [(i, " ".join(rng.choice([f"word{j}" for j in range(kinds)]) for _ in range(n))) for i, (kinds, n) in enumerate([(40, 60), (3, 30), (13, 400), (12, 24), (20, 25), (1, 9), (300, 300)])]
    docs = lines._texts(table(spark, rows), "doc_id", "text")
    for common in ([], list(range(0, 400, 2))):
        last = f"IF(cast(h & {lines.WORD_CLASSES - 1}L as int) IN ({str(common)[1:-1]}), h | {1 << 62}L, h)" if common else "h"
        wanted = F.expr(f"transform(slice(array_distinct(sort_array(transform(wh, h -> {last}))), 1, {lines.SKETCH}), h -> cast(shiftright(h, 32) as int))")
        wanted = {r["doc_id"]: r["w"] for r in lines.worded_lines(docs, 5).select("doc_id", wanted.alias("w")).collect()}
        assert {r["doc_id"]: r["least"] for r in lines.sketched_lines(docs, 5, common).collect()} == wanted


def test_signs_are_shuffled_not_words(spark, monkeypatch):
    docs = lines._texts(table(spark, [(1, "one two three four five\nx"), (1, "one two three four five\nx"), (2, "a b c d e f g")]), "doc_id", "text")
    written = lines.sketched_lines(docs, 5, []).checkpoint().dropDuplicates(["doc_id"])
    places = written.select("id", F.struct("doc_id", "th", "pos").alias("first"))
    kept, checkpointed = [], lines.checkpointed
    monkeypatch.setattr(lines, "checkpointed", lambda df: kept.append(df) or checkpointed(df))
    found = lines._signed(checkpointed(places.select("id")), checkpointed(places), docs).collect()
    assert sorted((r["n"], len(r["s"])) for r in found) == [(5, 5), (7, 7)]  # rows equal in id and text give one
    plan = kept[-1]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "first(" not in plan


# ---------------------------------------------------------------- op1


def test_rates_reach_the_targets(spark):
    rng = random.Random(1)
    stock = {"good": WORDS, "low": [w + "q" for w in WORDS], "toxic": [w + "z" for w in WORDS]}
    rows, labels = [], []
    for i in range(300):
        d = rng.choice(["good", "good", "good", "low", "toxic"])
        rows.append((i, " ".join(rng.choice(stock[d] if rng.random() < 0.6 else WORDS) for _ in range(rng.randint(3, 60)))))
        if i % 3 == 0:
            labels.append((i, d))
    labels += [(None, "good"), (5, None), (9999, "low")]
    docs = table(spark, [*rows, *ODD]).withColumn("domain", F.lit("x")).withColumn("word", F.lit("y"))
    want = {"good": 0.7, "low": 0.2, "toxic": 0.1}
    found = mixing.mix(docs, table(spark, labels, "doc_id long, domain string"), want).collect()
    assert len(found) == 300 + 7 and all(r["rate"] >= 0 for r in found)
    total = sum(r["n_tokens"] for r in found)
    for d, share in want.items():
        assert math.isclose(sum(r["rate"] * r["n_tokens"] * r[f"p_{d}"] for r in found), share * total, rel_tol=1e-3)
    assert all(math.isclose(r["p_good"] + r["p_low"] + r["p_toxic"], 1, rel_tol=1e-9) for r in found)
    by = {r["doc_id"]: r for r in found}
    assert by[705]["n_tokens"] == 8000 and by[700]["n_tokens"] == by[702]["n_tokens"] == 0
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in found)


def test_clean_documents_are_kept_at_any_mix(spark):
    # 99 % of the tokens are good, more than the target; short texts without a telling word have the prior
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(50))) for i in range(300)] + [(300 + i, " ".join(rng.choice(WORDS) + "q" for _ in range(50))) for i in range(3)]
    rows += [(400 + i, "neutral") for i in range(40)]
    labels = [(i, "good") for i in range(60)] + [(300 + i, "low") for i in range(3)]
    found = mixing.mix(table(spark, rows), table(spark, labels, "doc_id long, domain string"), queries.MIX, keep="good").collect()
    assert len(found) == 343 and all(r["rate"] >= 1 and r["copies"] >= 1 for r in found if not 300 <= r["doc_id"] < 400)


def test_rates_are_the_nearest_to_one_at_the_targets(spark):
    # against projected gradients over every rate in numpy, run to the end, with rates at zero
    import numpy as np

    rng = np.random.default_rng(4)
    n, p = rng.integers(1, 50, 60), rng.dirichlet([0.4, 0.3, 0.3], 60)
    targets = np.array([0.75, 0.2, 0.05])
    soft = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(60)], "doc_id long, n_tokens long, p_0 double, p_1 double, p_2 double")
    rated, report = mixing.fit_rates(soft, targets.tolist())
    found = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
    share, dual = n / n.sum(), np.zeros(3)
    for _ in range(200_000):
        rate = np.maximum(0, 1 - p @ dual)
        dual += 0.5 * ((rate * share) @ p - targets)
    assert (found == 0).any() and report["steps"] > 1 and report["gap"] <= 1e-6
    assert np.allclose((found * share) @ p, targets, atol=1e-5) and np.allclose(found, rate, atol=1e-3)


def test_targets_out_of_reach_leave_a_gap(spark):
    rows = [(i, "a b c") for i in range(10)]
    found = mixing.mix(table(spark, rows), table(spark, [(0, "x"), (1, "y")], "doc_id long, domain string"), {"x": 0.9, "y": 0.1}).collect()
    assert all(abs(r["gap"] - 0.4) < 1e-3 and r["rate"] >= 0 for r in found)


def test_rates_at_the_bound(spark):
    soft = spark.createDataFrame([(i, 10, float(i % 2), 1.0 - i % 2) for i in range(20)], "doc_id long, n_tokens long, p_0 double, p_1 double")
    rated, report = mixing.fit_rates(soft, [1.0, 0.0])
    assert {r["p_0"]: round(r["rate"], 6) for r in rated.collect()} == {0.0: 0.0, 1.0: 2.0} and report["steps"] <= 2


def test_mixing_without_labels_or_documents(spark):
    none = table(spark, [], "doc_id long, domain string")
    assert [(r["rate"], r["copies"]) for r in mixing.mix(table(spark, [(1, "a b")]), none, {"x": 1.0}).collect()] == [(1.0, 1)]
    assert mixing.mix(table(spark, []), table(spark, [(1, "x")], "doc_id long, domain string"), {"x": 1.0}).count() == 0


def test_domains_of_labels(spark):
    rows = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert [r["domain"] for r in queries.label_domains(rows).orderBy("doc_id").collect()] == ["good", "low", "toxic", None]
    assert zlib.crc32(b"7") % 5 == spark.range(7, 8).select(queries.crc_remainder("id", 5)).first()[0]
