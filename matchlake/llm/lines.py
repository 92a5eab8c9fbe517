"""Fuzzy line deduplication with DataFrame functions only.

Lines are normalised to their words; equal ones are grouped by a 128-bit hash before
anything else, so a line that a third of all documents share is one row from then on. The
distinct lines are joined on blocks: three words next to each other among a line's SKETCH first words in an order that all
lines share (short and frequent words last, else by hash); two words, in short lines. Two lines share a block unless edits
come between all of those words. A SimHash of the line
cannot do this: at an edit similarity of 0.8 it differs in about 13 of 64 bits, which no
choice of its blocks finds at a bearable number of keys. Pairs are verified by edit similarity over
words, and one occurrence of each connected group stays.

A block of at most FEW lines gives all its pairs. A larger one's members are first joined to one of them alone, and only lines that this leaves in
different groups are joined with each other: a family of thousands of variants gives about
one pair each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import checkpointed, connected_components, hidden, sized, written

MIN_WORDS = 5
SIMILARITY = 0.8
#: First words of a line that its blocks are made of: three in a row; lines of at most SHORT words have pairs of the
#: first SHORT_SKETCH instead, and from 0.8 SHORT words on a line has both.
SKETCH, SHORT, SHORT_SKETCH = 12, 15, 8
#: First words that two lines must have in common before their texts are compared, if both have SKETCH different ones.
ALIKE = 5
#: Lines of a block that is compared in all its pairs.
FEW = 32
#: Ids end with a class of the line's number of words: APART classes are more than a similarity of 0.8 allows.
CLASSES, APART = 64, 5
#: Words that come last, as those of one or two letters do: frequent in several languages. By longer words' length no order
#: is made: of lines whose edits are longer words than theirs recall fell from 0.96 to 0.93 when words of three letters came last, to 0.79 by classes up to seven.
LATE = (
    "the and for that this with was are not but you his her they have had from all der die und das den von mit ist ein les des une que est pas "
    "pour dans par sur los las del con por una para"
).split()
#: If blocks over FEW hold more lines, each counted as often as it is in one, than there are lines, words are counted and common ones come last as well.
#: A class of words is common if it has more than one word in COMMON_IN lines; at most HOT of WORD_CLASSES (by a hash) are.
#: Words that come last are left out of blocks, so edits weigh more on the others: with one in 256 lines recall fell from 0.94 to 0.79.
COMMON_IN, HOT, WORD_CLASSES = 8, 2048, 1 << 16
#: One text in SAMPLE is counted: all of them.
SAMPLE = 1


def lower_line(line: Column) -> Column:
    return F.lower(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))


def words_of(line: Column) -> Column:
    """Lower-case words between white space."""
    return F.array_remove(F.split(lower_line(line), " "), "")


def word_place(word: Column) -> Column:
    """Where a word comes in the order of a line's words: words of one or two letters and LATE ones last, else by 60 bits of its hash; -1: no word."""
    late = F.when((F.length(word) <= 2) | word.isin(*LATE), F.lit(1 << 60)).otherwise(F.lit(0).cast("long"))
    return F.when(word == "", F.lit(-1).cast("long")).otherwise(late.bitwiseOR(F.xxhash64(word).bitwiseAND(F.lit((1 << 60) - 1))))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, text) of rows with a text; th tells apart rows that share an id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("text IS NOT NULL")


def worded_lines(texts: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, doc_id, th, pos, n, wh): each line of at least ``min_words`` words with their number and hashes."""
    # hashes come out of the generator, so that the filter does not split the text once more; one lambda, as each is interpreted for every word
    words = F.transform(F.split(lower_line(F.col("text")), "\n"), lambda x: F.array_remove(F.transform(F.split(x, " "), word_place), F.lit(-1).cast("long")))
    named = texts.select("doc_id", "th", F.posexplode(words).alias("pos", "wh")).where(F.size("wh") >= max(1, min_words)).withColumn("n", F.size("wh"))
    return named.select(F.xxhash64("wh").alias("h1"), F.xxhash64(F.lit(7), "wh").alias("h2"), "doc_id", "th", "pos", "n", "wh")


def common_words(texts: DataFrame) -> list[int]:
    """The classes of the commonest words, at most HOT, counted over all texts. They order a line's words: the more there are, the fewer pairs meet by chance or at all."""
    line = F.col("text")
    lines = texts.agg(F.sum(F.length(line) - F.length(F.replace(line, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    words = texts.select(F.explode(F.split(lower_line(F.replace(line, F.lit("\n"), F.lit(" "))), " ")).alias("w")).where("w != ''")
    counted = words.groupBy(F.expr(f"cast(xxhash64(w) & {WORD_CLASSES - 1}L as int)").alias("c")).agg(F.count("*").alias("words"))
    counted = counted.where(F.col("words") > max(3, lines / COMMON_IN)).orderBy(F.desc("words"), "c").limit(HOT).collect()
    return [r["c"] for r in counted]


def sketched_lines(texts: DataFrame, min_words: int, common: list[int]) -> DataFrame:
    """(id, h1, h2, doc_id, th, pos, n, least): lines with their first SKETCH words in the common order."""
    least = "wh"
    if common:
        least = f"transform(wh, h -> h | CASE WHEN cast(h & {WORD_CLASSES - 1}L as int) IN ({', '.join(map(str, common))}) THEN {1 << 62}L ELSE 0L END)"
    # most lines' first different words are among the first 2 * SKETCH, so the others are not told apart; two steps, as each is used twice
    named = worded_lines(texts, min_words).withColumn("sorted", F.expr(f"sort_array({least})")).withColumn("first", F.expr(f"array_distinct(slice(sorted, 1, {2 * SKETCH}))"))
    enough = f"CASE WHEN size(first) >= {SKETCH} OR size(sorted) <= {2 * SKETCH} THEN first ELSE array_distinct(sorted) END"
    # of a place 31 bits are left: common or not, late or not, and 28 of the hash
    least = f"transform(slice({enough}, 1, {SKETCH}), h -> cast(shiftright(h, 32) as int))"
    size = F.least(F.lit(CLASSES - 1), F.floor(F.log("n") * 16) - 24)  # 16 classes a factor of e, from 5 words
    return named.select((F.monotonically_increasing_id() * CLASSES + F.greatest(F.lit(0), size)).alias("id"), "h1", "h2", "doc_id", "th", "pos", "n", F.expr(least).alias("least"))


def block_keys(of: str = "") -> Column:
    """Blocks of a line (n, least; ``of`` ends their names): runs of its first words, as long as the line allows; of a line with few different words, each of them too."""
    # lambdas over the array: a list of all cases would be too long a method to be compiled
    n, least = f"n{of}", f"least{of}"
    three = f"CASE WHEN {n} >= {SHORT * 4 // 5} AND size({least}) >= 3 THEN transform(sequence(0, size({least}) - 3), i -> xxhash64({least}[i], {least}[i + 1], {least}[i + 2])) ELSE array() END"
    two = f"CASE WHEN {n} <= {SHORT} AND size({least}) >= 2 THEN transform(sequence(0, least(size({least}), {SHORT_SKETCH}) - 2), i -> xxhash64({least}[i], {least}[i + 1])) ELSE array() END"
    one = f"CASE WHEN size({least}) <= 4 THEN transform({least}, x -> xxhash64(x)) ELSE array() END"
    return F.expr(f"concat({three}, {two}, {one})")


def keyed_lines(distinct: DataFrame, *columns: str) -> DataFrame:
    """A row (key and ``columns``) for each of a line's block_keys. Compiled as a whole: lambdas, here for every line, take several times as long."""
    threes, twos = SKETCH - 2, SHORT_SKETCH - 1
    last = f"CASE WHEN n <= {SHORT} OR size(least) <= 4 THEN {threes + twos + 3} ELSE size(least) - 3 END"
    at = distinct.select("n", "least", *[c for c in columns if c not in ("n", "least")], F.explode(F.expr(f"sequence(0, {last})")).alias("i"))
    three = f"WHEN i < {threes} THEN IF(n >= {SHORT * 4 // 5} AND i + 3 <= size(least), xxhash64(get(least, i), get(least, i + 1), get(least, i + 2)), NULL)"
    two = f"WHEN i < {threes + twos} THEN IF(n <= {SHORT} AND i - {threes - 2} <= least(size(least), {SHORT_SKETCH}), xxhash64(get(least, i - {threes}), get(least, i - {threes - 1})), NULL)"
    one = f"WHEN size(least) <= 4 AND i - {threes + twos} < size(least) THEN xxhash64(get(least, i - {threes + twos}))"
    return at.select(F.expr(f"CASE {three} {two} {one} END").alias("key"), *columns).where("key IS NOT NULL")


def _may(a: Column, b: Column) -> Column:
    """Whether two ids' classes of length allow their lines to be near."""
    return F.abs(F.pmod(a, F.lit(CLASSES)) - F.pmod(b, F.lit(CLASSES))) < APART


def _near(similarity: float) -> Column:
    """What is asked of two lines (n, least and with _b) before their words are compared: numbers of words that allow the
    similarity and, of the first words in common, ALIKE or as many as edits can have left of a line with fewer than SKETCH."""
    edits = F.floor(F.greatest("n", "n_b") * F.lit(1 - similarity) + F.lit(1e-9))
    few, many = F.least(F.size("least"), F.size("least_b")), F.greatest(F.size("least"), F.size("least_b"))
    asked = F.when(many < SKETCH, many - edits).when(few < SKETCH, few - edits * 2).otherwise(ALIKE)
    # words that are not in the other line are counted: two of one line that agree in their short form count as one there, so no pair is lost
    return (F.abs(F.col("n") - F.col("n_b")) <= edits) & (F.size("least") - F.size(F.array_except("least", "least_b")) >= asked)


def _short(least: str) -> Column:
    """First words by 15 bits of their hashes: 2 bytes each go with a pair."""
    return F.expr(f"transform({least}, x -> cast(x & 32767 as smallint))")


def _sign() -> Column:
    """The words as a string of one character each, chosen from 983,040 by a hash."""
    code = F.transform("words", lambda w: F.hex(F.lit(0x10000) + F.pmod(F.xxhash64(w), F.lit(0xF0000))))  # five digits
    return F.decode(F.unhex(F.concat(F.lit("000"), F.array_join(code, "000"))), "UTF-32")


def _signed(ids: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n, s): the lines of ``ids`` (id, distinct) with their number of words and _sign. The lines are read again; only signs, not words, are shuffled.

    places: (id, first) with a line's document and number.
    """
    wanted = places.join(sized(ids, 16), "id")
    wanted = checkpointed(wanted.groupBy(F.col("first.doc_id").alias("d"), F.col("first.th").alias("t")).agg(F.collect_list(F.struct("id", "first.pos")).alias("asked")))
    size = wanted.agg(F.sum(F.size("asked") + 4)).first()[0] or 0
    rows = texts.join(sized(wanted, 12, size), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("asked", F.split("text", "\n").alias("whole"))
    lines = rows.select(F.explode(F.transform("asked", lambda a: F.struct(a["id"].alias("id"), F.get("whole", a["pos"]).alias("line")))).alias("x"))
    lines = lines.select("x.id", words_of(F.col("x.line")).alias("words")).select("id", _sign().alias("s")).distinct()  # rows equal in id and text
    return checkpointed(lines.select("id", F.length("s").alias("n"), "s"))


def _verified(pairs: DataFrame, places: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of line ids whose words have an edit similarity of at least ``similarity``.

    Pairs that hold their lines' signs (s, s_b) and numbers of words (n, n_b) are compared where they are made; for others the lines are read
    again. A word becomes a character: two different words count as one if they agree in a hash of 983,040 values.
    """
    if "s" not in pairs.columns:
        pairs = checkpointed(pairs)
        if not pairs.take(1):
            return pairs
        lines = _signed(checkpointed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), places, texts)
        side = lambda x: lines.select(F.col("id").alias(x), *[F.col(c).alias(c + "_b" * (x == "b")) for c in ("n", "s")])
        pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    allowed = F.floor(F.greatest("n", "n_b") * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    return pairs.withColumn("allowed", allowed).where("levenshtein(s, s_b, allowed) >= 0").select("a", "b")


def _blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(distinct, twice, shared, members): a line for all that equal it, lines that occur twice, blocks of more than one line, and the lines of blocks of more than two."""
    twice = checkpointed(lines.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("id").alias("rep")).where("c > 1").select("h1", "h2", "rep"))
    distinct = lines.join(sized(twice, 32), ["h1", "h2"], "left").where("rep IS NULL OR rep = id")
    keyed = keyed_lines(distinct, "id")
    shared = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("a"), F.max("id").alias("b")).where("members > 1"))
    more = checkpointed(shared.where("members > 2").select("key", F.when(F.col("members") > FEW, F.col("b")).alias("pivot")))
    return distinct, twice, shared, checkpointed(keyed.join(sized(more, 24), "key"))


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(lines, groups): every line's occurrences (h1, h2, doc_id, th, pos), and of each line that occurs twice or has a near one (h1, h2, component)."""
    if similarity < 0.8:
        raise ValueError("classes of length are made for a similarity of 0.8 or more")
    texts = _texts(docs, id_col, text_col)
    lines = written(sketched_lines(texts, min_words, []))
    distinct, twice, shared, members = _blocks(lines)
    if members.where("pivot IS NOT NULL").count() > lines.count():  # crowded: words are common that are not short
        lines = written(sketched_lines(texts, min_words, common_words(texts)))
        distinct, twice, shared, members = _blocks(lines)
    places = distinct.select("id", F.struct("doc_id", "th", "pos").alias("first"))
    hot = members.where("pivot IS NOT NULL")
    few = members.where("pivot IS NULL").groupBy("key").agg(F.collect_list("id").alias("ids"))  # at most FEW
    few = few.select(F.explode("ids").alias("a"), "ids").select("a", F.explode("ids").alias("b")).where("a < b")
    pairs = shared.where("members = 2").select("a", "b").union(few).union(hot.where("id < pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))
    pairs = checkpointed(pairs.where(_may(F.col("a"), F.col("b"))).distinct())
    # the lines that met any other, with what is asked before their texts are compared
    met = checkpointed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(hot.select("id")).distinct())
    met = checkpointed(lines.select("id", "n", "least").join(sized(met, 16), "id"))
    side = lambda x: met.select(F.col("id").alias(x), *[c.alias(name + "_b" * (x == "b")) for name, c in (("n", F.col("n")), ("least", _short("least")))])
    near = _near(similarity)
    first = checkpointed(_verified(pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b"), places, texts, similarity))
    merged = connected_components(first, native=True)
    if hot.take(1):
        own = hot.select("key", "id").join(merged.select(F.col("node").alias("id"), F.col("component").alias("own")), "id", "left").select("key", "id", F.coalesce("own", "id").alias("own"))
        # blocks whose lines are not all in one group yet, with their lines' signs: only pairs that are near leave the join
        apart = own.groupBy("key").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x != y").select("key")
        own = checkpointed(own.join(sized(checkpointed(apart), 16), "key"))
        ids = checkpointed(own.select("id").distinct())
        signs = _signed(ids, places, texts).select("id", "s")
        own = checkpointed(own.join(met.join(sized(ids, 16), "id").join(signs, "id"), "id"))
        left = own.select("key", "n", "least", "s", F.col("id").alias("a"), F.col("own").alias("x"))
        right = own.select("key", *[F.col(c).alias(f"{c}_b") for c in ("n", "least", "s")], F.col("id").alias("b"), F.col("own").alias("y"))
        # of a pair's blocks the first tells; if that one is small, the pair has been compared
        once = F.array_min(F.array_intersect(block_keys(), block_keys("_b"))) == F.col("key")
        rest = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("x") != F.col("y")) & near & once)
        second = checkpointed(_verified(rest, places, texts, similarity))
        merged = connected_components(first.unionByName(second), native=True) if second.take(1) else merged
    linked = checkpointed(merged.select(F.col("node").alias("id"), "component"))
    linked = lines.select("id", "h1", "h2").join(sized(linked, 16), "id").select("h1", "h2", "component")
    groups = checkpointed(linked.unionByName(twice.select("h1", "h2", F.col("rep").alias("component")).join(linked, ["h1", "h2"], "left_anti")))
    return lines.select("h1", "h2", "doc_id", "th", "pos"), groups


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, kept_col: str = "kept", removed_col: str = "removed") -> DataFrame:
    """``docs`` with ``removed`` (array of line numbers from 0) and ``kept`` (the text without them).

    Lines end with a line feed; words stand between spaces, tabs and carriage returns. Of each
    connected group of lines whose words are equal, or near (edit similarity over words of at least
    ``similarity``), the occurrence in the smallest doc_id, first in it, stays; null
    ids come first. Lines of fewer than ``min_words`` words always stay. A null text
    stays null with nothing removed. Rows equal in id and text are one document and
    all keep its lines. Other columns pass through; columns named as the two new ones are replaced.

    Recall of a pair by itself, if edits fall on any words alike and none is common: 0.93 to 1 at a similarity of 0.8 (from 100 words
    down to 5), 0.997 at 0.9. Comparing two lines of n words takes n^2 / 5 steps.
    """
    lines, groups = line_groups(docs, id_col, text_col, min_words, similarity)
    found = checkpointed(lines.join(sized(groups, 24), ["h1", "h2"]).select("component", F.struct("doc_id", "th", "pos").alias("own")))
    keepers = checkpointed(found.groupBy("component").agg(F.min("own").alias("keeper")))
    gone = found.join(sized(keepers, 40), "component").where("own != keeper")
    d, t, g, n, w = hidden(docs, "_line_id", "_line_th", "_line_gone", "_line_own", "_line_whole")
    gone = checkpointed(gone.groupBy(F.col("own.doc_id").alias(d), F.col("own.th").alias(t)).agg(F.collect_set("own.pos").alias(g)))
    size = gone.agg(F.sum(F.size(g) + 12)).first()[0] or 0
    text = F.col(text_col).cast("string")
    joined = docs.withColumn(n, F.xxhash64(text)).join(sized(gone, 4, size), F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.col(n) == F.col(t)) & text.isNotNull(), "left")
    joined = joined.withColumn(w, F.when(F.col(g).isNotNull(), F.split(text, "\n")))
    # the lines' numbers less those that go, by hash: no search for each line
    stay = F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col(g))
    kept = F.when(F.col(g).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(w), i)), "\n"))
    return joined.withColumns({removed_col: F.coalesce(F.sort_array(g), F.array().cast("array<int>")), kept_col: kept}).drop(d, t, g, n, w)
