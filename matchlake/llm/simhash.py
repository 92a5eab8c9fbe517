"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed from whole texts; distinct fingerprints are dealt into tiles by
their population counts. Two fingerprints that differ in at most r bits have population
counts at most r apart, in the whole word and summed over its parts, so only tile
pairs within that radius are compared: numpy exclusive-or and bit counts, every pair, no
candidate left out. Of the pairs that a task finds near it gives those that connect them, nearest first, so a
family of near copies gives about as many links as members. More documents mean more parts a word is counted in, and so more and
finer tiles.

With a wide radius, tiles would compare nearly all pairs. Where a link asks for a Jaccard similarity as well, that one
says which fingerprints to compare: two sets that reach it have a shingle in common among the first of each in the order
of their hashes (as many as may differ, and one), so fingerprints are joined on these. No pair that would link is left out.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import as_batch, checkpointed, connected_components, partitions, pieces, sized

#: Members of a tile that one task compares with its visitors, and pairs it compares at a time.
CHUNK, BLOCK = 16_384, 2 << 20
_SEED = 42
_ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_SKETCHED = pa.schema([*_ARROW, ("least", pa.list_(pa.int64()))])
#: Fingerprints that share a shingle and are compared in all their pairs; more are compared with one of them first.
FEW = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text: A-Z lower-cased, shingles of ``words`` words, repeats counted.

    Fewer words: the whole sequence is the one shingle. No word or null: zero.
    """
    return _signed(_shingles((text or "").encode("utf-8", "replace").lower(), words))


def _shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included; no word: none."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, "<u8")
    flat = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(words, len(tokens))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[i:j], _SEED) for i, j in zip(starts, stops)], dtype="<u8")


def _signed(hashes: np.ndarray) -> int:
    """The word whose bits are 1 where they are in over half of the hashes; of no hash zero."""
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[part : part + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def first_shingles(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The least distinct hashes, so many that two sets with a Jaccard similarity of ``similarity`` have one of them in common."""
    own = np.unique(hashes)
    return own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(doc_id, fp, least) for every row: fingerprints, and the first shingles of the texts in lower case (all letters, as similar() has them)."""

    def sketch(text: str | None):
        plain, lower = (text or "").encode("utf-8", "replace").lower(), (text or "").lower().encode("utf-8", "replace")
        hashes = _shingles(plain, words)
        return _signed(hashes), first_shingles(hashes if plain == lower else _shingles(lower, words), similarity).view(np.int64)

    def run(batches):
        for batch in pieces(batches):
            fps, least = zip(*map(sketch, batch.column(1).to_pylist()))
            yield as_batch(_SKETCHED, batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(least, pa.list_(pa.int64())))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, least array<long>")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; null texts have fingerprint zero, null ids stay null."""

    def run(batches):
        for batch in pieces(batches):
            yield as_batch(_ARROW, batch.column(0), pa.array(np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def parts_for(distinct: int, per_tile: int = 1024, radius: int = 2) -> int:
    """In how many equal parts of the 64 bits population counts are taken, so that a tile stays small; beyond 4 bits the whole word, since a part's counts tell little."""
    if radius > 4:
        return 1
    for parts, bits in ((1, 5), (2, 9), (4, 12), (8, 20)):  # about log2 of the tiles that random bits fill
        if distinct >> bits <= per_tile:
            break
    return parts


def links(fps: DataFrame, distinct: int, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of rows of ``fps`` (fp, rep), distinct in fp, whose fps differ in 1..radius bits: enough to connect all such pairs."""
    spark, parts = fps.sparkSession, parts_for(distinct, radius=radius)
    width = 64 // parts
    count = lambda i: F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)))
    tiled = fps.withColumn("tile", sum((F.shiftleft(count(i).cast("long"), 7 * i) for i in range(parts)), F.lit(0).cast("long")))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius and d >= (0,) * parts] if parts < 8 else _steps(parts, radius)
    deltas = F.array(*[F.lit(sum(x << (7 * i) for i, x in enumerate(d))).cast("long") for d in steps])
    sizes = sized(checkpointed(sizes), 32)
    home = tiled.join(sizes, "tile").select("tile", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("home"), "fp", "rep")
    visit = tiled.select(F.explode(F.transform(deltas, lambda d: F.col("tile") + d)).alias("tile"), "fp", "rep").join(sizes, "tile")
    visit = visit.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("home"), "fp", "rep")
    buckets = partitions(spark, distinct * (len(steps) + 1))
    rows = home.unionByName(visit).withColumn("bucket", F.pmod(F.xxhash64("tile", "chunk"), F.lit(buckets * 4)).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tile", "chunk", "home"], kind="stable")
        tile, chunk, home = (pdf[c].to_numpy() for c in ("tile", "chunk", "home"))
        fp, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (chunk[1:] != chunk[:-1])])
        left, right = [], []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(fp)]):
            mid = lo + int((~home[lo:hi]).sum())
            step = max(1, BLOCK // max(1, hi - mid))
            for part in range(lo, mid, step):
                stop = min(mid, part + step)
                apart = np.bitwise_count(fp[part:stop, None] ^ fp[None, mid:hi])
                far = apart > radius
                own = np.flatnonzero(tile_of(fp[part:stop], parts) == tile[lo])
                far[own] |= fp[part + own, None] >= fp[None, mid:hi]  # a tile visits itself too: each pair once
                if far.all():
                    continue
                apart[far] = FAR
                i, j = connecting(apart)
                left.append(rep[part + i])
                right.append(rep[mid + j])
        return pd.DataFrame({"a": np.concatenate(left or [rep[:0]]), "b": np.concatenate(right or [rep[:0]])})

    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(compare, "a long, b long")


#: Stands for a distance beyond the radius.
FAR = 255


def connecting(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) under FAR that connect all rows and columns that such places connect: rounds of each row's nearest column of another group."""
    rows, columns = (np.flatnonzero((apart < FAR).any(axis=x)) for x in (1, 0))
    apart = apart[np.ix_(rows, columns)]
    label = np.arange(len(rows) + len(columns))
    out_i, out_j = [], []
    while True:
        other = np.where(label[: len(rows), None] == label[None, len(rows) :], FAR, apart)
        best = other.argmin(axis=1)
        for i in np.flatnonzero(other[np.arange(len(rows)), best] < FAR).tolist():
            x, y = label[i], label[len(rows) + best[i]]
            if x != y:
                label[label == max(x, y)] = min(x, y)
                out_i.append(rows[i])
                out_j.append(columns[best[i]])
        if not out_i or not (other < FAR).any():
            return np.array(out_i, np.int64), np.array(out_j, np.int64)


def similar(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of ids whose texts have an exact Jaccard similarity of at least ``similarity`` over shingles of ``words`` words."""
    pairs = checkpointed(pairs.distinct())
    asked = checkpointed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(sized(asked, 16), "id")
    texts = texts.groupBy("id").agg(F.max("text").alias("text"))  # rows that share an id: one of them
    own = texts.select("id", F.expr(r"array_remove(split(lower(text), '[ \\t-\\r]+'), '')").alias("w"))
    shingles = f"array_distinct(transform(sequence(0, greatest(0, size(w) - {words})), i -> xxhash64(slice(w, i + 1, {words}))))"
    own = checkpointed(own.select("id", F.expr(shingles).alias("s")))
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("both"))
    return both.where(F.col("common") >= F.lit(similarity) * (F.col("both") - F.col("common")) - 1e-9).select("a", "b")


def similar_links(keyed: DataFrame, nodes: DataFrame, radius: int, check) -> DataFrame:
    """Pairs (a, b) of rows of ``nodes`` (fp, rep) that connect all pairs of fps at most ``radius`` bits apart which share a key of
    ``keyed`` (key, fp; distinct) and pass ``check``, a function from pairs of reps to those that hold.

    Of keys with the same fps one speaks for all. Keys of over FEW fps give pairs with one of them; after that only fps that are
    in different groups are compared.
    """
    spark = keyed.sparkSession
    name = lambda side: nodes.select(F.col("fp").alias(side), F.col("rep").alias(f"{side}_rep"))

    def holding(pairs: DataFrame) -> DataFrame:
        """Of pairs of fps, those of reps that hold."""
        named = checkpointed(pairs.distinct()).join(name("a"), "a").join(name("b"), "b")
        return checkpointed(check(named.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs within the radius whose ``own`` differs, of all that share a key; of a key with a pivot and no groups yet, pairs with the greatest."""
        pdf = pdf.sort_values(["key", "fp"], kind="stable")
        key, fp, own, star = (pdf[c].to_numpy() for c in ("key", "fp", "own", "star"))
        bits = fp.view(np.uint64)
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        left, right = [fp[:0]], [fp[:0]]
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(fp)]):
            _, of, size = np.unique(own[lo:hi], return_inverse=True, return_counts=True)
            # one of a pair is outside the largest group
            out = np.array([hi - 1]) if star[lo] else lo + np.flatnonzero(of != size.argmax())
            step = max(1, BLOCK // (hi - lo))
            for at in range(0, len(out), step):
                rows = out[at : at + step]
                i, j = np.nonzero((np.bitwise_count(bits[rows, None] ^ bits[None, lo:hi]) <= radius) & (own[rows, None] != own[None, lo:hi]))
                left.append(fp[rows[i]])
                right.append(fp[lo + j])
        left, right = np.concatenate(left), np.concatenate(right)
        return pd.DataFrame({"a": np.minimum(left, right), "b": np.maximum(left, right)}).drop_duplicates()

    def compared(rows: DataFrame) -> DataFrame:
        buckets = partitions(spark, rows.count())
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets * 4)).cast("int"))
        return rows.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(compare, "a long, b long")

    sign = [F.bit_xor(F.xxhash64(F.lit(no), "fp")).alias(f"sign{no}") for no in (1, 2)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("fp").alias("a"), F.max("fp").alias("b"), *sign).where("members > 1")
    shared = checkpointed(shared.groupBy("members", "a", "b", "sign1", "sign2").agg(F.min("key").alias("key")))
    more = checkpointed(shared.where("members > 2").select("key", (F.col("members") > FEW).alias("star")))
    members = checkpointed(keyed.join(sized(more, 16), "key"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    first = holding(shared.where("members = 2").select("a", "b").where(close).unionByName(compared(members.select("key", "fp", F.col("fp").alias("own"), "star"))))
    hot = members.where("star")
    if hot.isEmpty():
        return first
    groups = connected_components(first).select(F.col("node").alias("rep"), "component")
    own = nodes.join(groups, "rep", "left").select("fp", F.coalesce("component", "rep").alias("own"))
    return first.unionByName(holding(compared(checkpointed(hot.select("key", "fp").join(own, "fp").select("key", "fp", "own", F.lit(False).alias("star"))))))


def tile_of(fp: np.ndarray, parts: int) -> np.ndarray:
    width, out = 64 // parts, np.zeros(len(fp), np.int64)
    mask = np.uint64((1 << width) - 1)
    for i in range(parts):
        out += np.bitwise_count((fp >> np.uint64(i * width)) & mask).astype(np.int64) << (7 * i)
    return out


def _steps(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Integer steps of ``parts`` places within ``radius``, one of each opposite pair, and the zero step."""
    found = {(0,) * parts}
    for _ in range(radius):
        found |= {(*d[:i], d[i] + s, *d[i + 1 :]) for d in found for i in range(parts) for s in (-1, 1)}
    return sorted(d for d in found if d >= (0,) * parts)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id reachable over fingerprints at most
    ``radius`` bits apart. Equal fingerprints are one node, however many documents share
    them. Repeated rows come back repeated; a null id takes part with its text but
    names no group (a group of null ids only has component null). Other columns are ignored.
    With a ``similarity``, links between different fingerprints hold only if the texts' exact Jaccard similarity of
    shingles reaches it; all such links are found.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words) if similarity is None else sketches(docs, id_col, text_col, words, similarity))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    n = nodes.count()
    named = nodes.where("rep IS NOT NULL").select("fp", "rep")
    if similarity is None:
        near = links(named, n, radius)
    else:
        # of rows with one fingerprint the first speaks for all
        several = sized(checkpointed(nodes.where("rows > 1").select("fp", "rep")), 24)
        own = fps.where("doc_id IS NOT NULL").join(several, "fp", "left_anti").select("fp", "least").union(fps.join(several, "fp").where("doc_id = rep").select("fp", "least").dropDuplicates(["fp"]))
        near = similar_links(own.select(F.explode("least").alias("key"), "fp"), named, radius, lambda pairs: similar(pairs, docs, id_col, text_col, words, similarity))
    groups = connected_components(near)
    nodes = nodes.join(groups, nodes["rep"] == groups["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(sized(nodes, 48, n), "fp").select("doc_id", "fp", "component_id")
