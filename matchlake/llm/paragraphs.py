"""Substring deduplication by paragraphs: MinHash banding, exact Jaccard, components.

Paragraphs are lines. Equal ones are grouped by a 128-bit hash; the distinct ones get a MinHash
of their five-word shingles, cut in bands tuned for high recall at the threshold.
Paragraphs that collide in a band are joined with one of its paragraphs; where that leaves
different groups in a band, its members are compared with each other, in tiles. Every
link is verified by the exact Jaccard similarity of the shingle sets. Removals are clustered by components, and
the first occurrence of each stays.

A passage that was pasted into the middle of a paragraph makes no two paragraphs alike.
So the text is also cut into content-defined passages, whose ends depend only on the
bytes near them, and equal passages (Jaccard 1) form components of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import checkpointed, connected_components, partitions, pieces, sized
from matchlake.llm.suffixes import _hashes, _powers

SHINGLE, SIMILARITY = 5, 0.8
#: Words of the shortest paragraph that is compared: headings and list items stay.
MIN_WORDS = 8
#: The least recall that the bands are tuned for at the threshold, and the rows of a band.
RECALL, BAND_ROWS = 0.995, 3
#: A passage's ends are places whose hash is the least within so many bytes; a passage has PASSAGE bytes at least.
REACH, PASSAGE = 28, 72
#: Bytes of text whose shingles are made at a time: numpy holds about 60 bytes for each.
PIECE = 512 << 10
#: Bytes of text for each passage, about.
PASSAGE_STEP = 100
#: Members on a side of a tile of a band.
TILE = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float = SIMILARITY, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """Bands that a pair at the threshold shares one of with probability ``recall``."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Spans:
    """Hashes of any spans of a byte string, by prefix sums; ``base`` picks the hash function."""

    def __init__(self, data: np.ndarray, base: int):
        if len(_tables.get(base, ((),))[0]) < len(data) + 1:
            _tables[base] = _powers(base, len(data) + 1), _powers(pow(base, -1, 1 << 64), len(data) + 1)
        self.up, down = _tables[base]
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[: len(data)], out=self.total[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.total[stop] - self.total[start]) * self.up[start] + (stop - start).astype(np.uint64) * _ODD)


BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def shingled(paragraphs: list[bytes], width: int = SHINGLE):
    """(shingle hashes, owner of each, h1, h2, words): of paragraphs whose words are joined by one space.

    Fewer words than ``width``: one shingle of all of them; none: no shingle.
    """
    data = np.frombuffer(b"\n".join([*paragraphs, b""]), np.uint8)
    size = np.array([len(p) for p in paragraphs], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    ends = np.flatnonzero((data == 32) | (data == 10))
    owner = np.searchsorted(begin, ends, side="right") - 1
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    real = ends > starts
    starts, ends, owner = starts[real], ends[real], owner[real]
    words = np.bincount(owner, minlength=len(paragraphs))
    first = np.cumsum(words) - words
    no = np.arange(len(starts)) - first[owner]
    reach = np.minimum(width, words[owner])
    begins = no + reach <= words[owner]
    at = np.flatnonzero(begins)
    one, two = (Spans(data, b) for b in BASES)
    return one(starts[at], ends[at + reach[at] - 1]), owner[at], one(begin, begin + size), two(begin, begin + size), words


def band_keys(hashes: np.ndarray, owner: np.ndarray, count: int, bands: int, rows: int = BAND_ROWS) -> np.ndarray:
    """(count, bands) keys: each band's hash of its rows' minima; paragraphs without a shingle have zeros."""
    out = np.zeros((count, bands), np.uint64)
    if len(hashes):
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        who = owner[cuts]
        for b in range(bands):
            key = np.full(len(who), b + 1, np.uint64)
            for r in range(rows):
                salt = _mix(np.array([1 + b * rows + r], np.uint64) * _ODD)
                key = _mix(key * _ODD + np.minimum.reduceat(_mix(hashes ^ salt), cuts))
            out[who, b] = key
    return out


def split_paragraphs(text: str | None) -> tuple[list[int], list[int], list[bytes]]:
    """(start, stop, words) of each line: byte offsets in the UTF-8 text; words lower-cased (A-Z), single-spaced."""
    starts, stops, words = [], [], []
    at = 0
    for line in (text or "").encode("utf-8", "replace").split(b"\n"):
        starts.append(at)
        stops.append(at + len(line))
        words.append(b" ".join(line.lower().split()))
        at += len(line) + 1
    return starts, stops, words


def passages(text: bytes, reach: int = REACH, least: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, h1, h2): from each cut to the first cut at least ``least`` bytes on.

    A cut is a place where the hash of the next 8 bytes is less than at all places within
    ``reach`` bytes to either side; the text's ends are no cuts.
    """
    none = (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    if len(text) < least + 2 * reach + 8:
        return none
    data = np.frombuffer(text, np.uint8)
    h = _hashes(data, 8)
    low, have = h, 1
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    # low[i]: least of h[i .. i + reach - 1]
    n = len(h) - 2 * reach
    cut = reach + np.flatnonzero((h[reach : reach + n] < low[:n]) & (h[reach : reach + n] < low[reach + 1 : reach + 1 + n]))
    if len(cut) < 2:
        return none
    end = np.searchsorted(cut, cut + least)
    start, stop = cut[end < len(cut)], cut[end[end < len(cut)]]
    one, two = (Spans(data, b) for b in BASES)
    return start, stop, one(start, stop), two(start, stop)


_PARA = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_PARA_SQL = "doc_id long, th long, start long, stop long, h1 long, h2 long, bands array<long>"


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def paragraph_rows(source: DataFrame, min_words: int, bands: int) -> DataFrame:
    """Each paragraph of at least ``min_words`` words with its hashes and band keys."""

    def run(batches):
        for batch in pieces(batches, rows=256, limit=PIECE):
            ids, hashes, starts, stops, words = [], [], [], [], []
            for i, th, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                a, b, w = split_paragraphs(text)
                ids += [i] * len(a)
                hashes += [th] * len(a)
                starts += a
                stops += b
                words += w
            sh, owner, h1, h2, n = shingled(words)
            keep = np.flatnonzero(n >= min_words)
            keys = band_keys(sh, owner, len(words), bands)[keep].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
            take = lambda x: pa.array(np.array(x, np.int64)[keep])
            yield pa.RecordBatch.from_arrays([take(ids), take(hashes), take(starts), take(stops), pa.array(h1[keep].view(np.int64)), pa.array(h2[keep].view(np.int64)), lists], schema=_PARA)

    return source.mapInArrow(run, _PARA_SQL)


def shingle_sets(names: DataFrame, source: DataFrame) -> DataFrame:
    """(name, shingles): the sorted distinct shingle hashes of the named paragraphs, from one pass over the texts."""
    wanted = checkpointed(names.select("name.*").groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_list("start").alias("starts")))
    size = wanted.agg(F.sum(F.size("starts") + 4)).first()[0] or 0
    held = source.join(sized(wanted, 8, size), (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "text", "starts")
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in pieces(batches, rows=256, limit=PIECE):
            out = []
            for i, th, text, starts in zip(*(batch.column(c).to_pylist() for c in range(4))):
                a, _, words = split_paragraphs(text)
                asked = set(starts)
                own = [(s, w) for s, w in zip(a, words) if s in asked]
                sh, owner, _, _, _ = shingled([w for _, w in own])
                cuts = np.searchsorted(owner, np.arange(len(own) + 1))
                out += [(i, th, s, np.unique(sh[cuts[j] : cuts[j + 1]]).view(np.int64)) for j, (s, _) in enumerate(own)]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    sets = held.mapInArrow(run, "doc_id long, th long, start long, shingles array<long>").dropDuplicates(["doc_id", "th", "start"])
    return sets.select(F.struct("doc_id", "th", "start").alias("name"), "shingles")


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of sets with the exact Jaccard similarity: common elements are counted by a matrix product.

    ``right`` may be ``left`` itself. Elements that only one set has are left out of the
    product; they count in the sizes.
    """
    same = right is left
    ls, rs = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    values, back = np.unique(np.concatenate(left if same else [*left, *right]), return_inverse=True)
    cut = int(ls.sum())
    lb, rb = back[:cut], back if same else back[cut:]
    li, ri = np.repeat(np.arange(len(left)), ls), np.repeat(np.arange(len(right)), rs)
    often = np.bincount(lb, minlength=len(values))
    shared = often > 1 if same else (often > 0) & (np.bincount(rb, minlength=len(values)) > 0)
    column = np.cumsum(shared) - 1
    li, lb, ri, rb = li[shared[lb]], column[lb[shared[lb]]], ri[shared[rb]], column[rb[shared[rb]]]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), 4096):  # some columns of the incidence matrices at a time
        wide = min(4096, int(shared.sum()) - at)
        lk, rk = (lb >= at) & (lb < at + wide), (rb >= at) & (rb < at + wide)
        x = np.zeros((len(left), wide), np.float32)
        x[li[lk], lb[lk] - at] = 1
        y = x
        if not same:
            y = np.zeros((len(right), wide), np.float32)
            y[ri[rk], rb[rk] - at] = 1
        common += x @ y.T
    return np.nonzero(common >= similarity * (ls[:, None] + rs[None, :] - common) - 1e-6)


def _band_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members (band, id, own, shingles) of a band that are near and of different groups.

    A band is compared in tiles of at most TILE members on a side; a tile gives no more links
    than connect what it connects, and no pair leaves it that is not near.
    """
    spark = members.sparkSession
    sizes = checkpointed(members.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")))
    rows = members.join(sizes, "band").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("x"), F.greatest("tile", o).alias("y")))))
    buckets = partitions(spark)
    rows = rows.select("band", "pair.x", "pair.y", F.when(F.col("tile") == F.col("pair.x"), 0).otherwise(1).alias("side"), "id", "own", "shingles")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("band", "x", "y"), F.lit(4 * buckets)).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        above: dict[int, int] = {}

        def root(i: int) -> int:
            above.setdefault(i, i)
            while above[i] != i:
                above[i] = above[above[i]]
                i = above[i]
            return i

        pdf = pdf.sort_values(["band", "x", "y"], kind="stable")
        key = pdf[["band", "x", "y"]].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1), True])
        ids, own, side, sets = pdf["id"].to_numpy(), pdf["own"].to_numpy(), pdf["side"].to_numpy(), pdf["shingles"].to_numpy()
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            left = lo + np.flatnonzero(side[lo:hi] == 0)
            right = left if key[lo, 1] == key[lo, 2] else lo + np.flatnonzero(side[lo:hi] == 1)
            if not len(left) or not len(right):
                continue
            mine = list(sets[left])
            i, j = near_pairs(mine, mine if right is left else list(sets[right]), similarity)
            for x, y in zip(left[i].tolist(), right[j].tolist()):
                if own[x] != own[y] and (p := root(int(own[x]))) != (q := root(int(own[y]))):
                    above[max(p, q)] = min(p, q)
                    out_a.append(ids[x])
                    out_b.append(ids[y])
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})

    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(compare, "a long, b long")


def paragraph_groups(source: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """(doc_id, th, start, stop, first) of each paragraph that has a near copy; first: its component's first occurrence."""
    bands = bands_for(similarity)
    rows = paragraph_rows(source, min_words, bands)
    name = F.struct("doc_id", "th", "start")
    rows = checkpointed(rows)
    distinct = checkpointed(rows.groupBy("h1", "h2").agg(F.min(F.struct(name.alias("name"), "bands")).alias("x"), F.count("*").alias("copies")).select("h1", "h2", "x.name", "x.bands", "copies"))
    distinct = distinct.withColumn("id", F.monotonically_increasing_id())  # the same in every reading of the written table
    keyed = distinct.select("id", F.explode("bands").alias("band"))
    # one paragraph of each band; bands of one paragraph say nothing
    pivot = checkpointed(keyed.groupBy("band").agg(F.max("id").alias("b"), F.count("*").alias("members")).where("members > 1").select("band", "b"))
    near = checkpointed(keyed.withColumnRenamed("id", "a").join(sized(pivot, 40), "band"))
    met = near.select(F.col("a").alias("id")).distinct()
    sets = shingle_sets(distinct.select("id", "name").join(met, "id").select("name"), source)
    sets = checkpointed(sets.join(distinct.select("id", "name"), "name").select("id", "shingles"))
    pairs = near.where("a != b").select("a", "b").distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    first = checkpointed(both.withColumn("common", common).where(F.col("common") >= F.lit(similarity) * (F.size("x") + F.size("y") - F.col("common")) - 1e-9).select("a", "b"))
    group = connected_components(first)
    own = checkpointed(near.select("band", F.col("a").alias("id")).join(group.select(F.col("node").alias("id"), "component"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("own")))
    # members that the pivots left in different groups meet each other
    mixed = own.groupBy("band").agg((F.min("own") != F.max("own")).alias("mixed")).where("mixed").select("band")
    links = _band_links(own.join(mixed, "band", "left_semi").join(sets, "id"), similarity)
    merged = connected_components(first.unionByName(links))
    linked = merged.select(F.col("node").alias("id"), "component").join(distinct.select("id", "name"), "id")
    firsts = linked.groupBy("component").agg(F.min("name").alias("first"))
    linked = linked.join(firsts, "component").select("id", "first")
    of = distinct.join(linked, "id", "left").where("copies > 1 OR first IS NOT NULL")
    of = checkpointed(of.select("h1", "h2", F.coalesce("first", "name").alias("first")))
    return rows.select("doc_id", "th", "start", "stop", "h1", "h2").join(sized(of, 64), ["h1", "h2"]).select("doc_id", "th", "start", "stop", "first")


_RECORD = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("start", "<i8"), ("stop", "<i8")])


def passage_groups(source: DataFrame) -> DataFrame:
    """(doc_id, th, start, stop, first) of each content-defined passage that occurs twice.

    What is sent to the task that compares are packed records, one binary value for each batch and target.
    """
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions(source.sparkSession, size // PASSAGE_STEP)
    sent = pa.schema([("target", pa.int32()), ("data", pa.binary())])

    def find(batches):
        for batch in pieces(batches, rows=2048, limit=4 << 20):
            parts = []
            for i, th, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                start, stop, h1, h2 = passages(text.encode("utf-8", "replace").lower())
                if len(start):
                    own = np.empty(len(start), _RECORD)
                    own["h1"], own["h2"], own["doc"], own["th"], own["start"], own["stop"] = h1, h2, i, th, start, stop
                    parts.append(own)
            if parts:
                found = np.concatenate(parts)
                target = (found["h1"] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(target, kind="stable")
                cuts = np.searchsorted(target[by], np.arange(buckets + 1))
                full = [t for t in range(buckets) if cuts[t + 1] > cuts[t]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([found[by[cuts[t] : cuts[t + 1]]].tobytes() for t in full], pa.binary())], schema=sent)

    result = pa.schema([(c, pa.int64()) for c in ("doc_id", "th", "start", "stop", "f_doc", "f_th", "f_start")])

    def compare(table: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(table["data"].to_pylist()), _RECORD)
        found = found[np.lexsort((found["h2"], found["h1"]))]
        new = np.r_[True, (found["h1"][1:] != found["h1"][:-1]) | (found["h2"][1:] != found["h2"][:-1])]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        found, group = found[many], group[many]
        by = np.lexsort((found["start"], found["th"], found["doc"], group))
        found, group = found[by], group[by]
        first = found[np.searchsorted(group, group)]
        # a text that repeats a passage only within itself and identical rows still have a first occurrence
        return pa.table([pa.array(np.ascontiguousarray(x)) for x in (found["doc"], found["th"], found["start"], found["stop"], first["doc"], first["th"], first["start"])], schema=result)

    rows = source.mapInArrow(find, "target int, data binary").groupBy("target").applyInArrow(compare, "doc_id long, th long, start long, stop long, f_doc long, f_th long, f_start long")
    return rows.select("doc_id", "th", "start", "stop", F.struct(F.col("f_doc").alias("doc_id"), F.col("f_th").alias("th"), F.col("f_start").alias("start")).alias("first"))


def merged_spans(starts, stops) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts, stops)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, shared, removed, n_removed, component_id): one row for each document.

    shared and removed are arrays of (start, stop) byte offsets in the UTF-8 text: what
    also occurs elsewhere, and what of it is not the first occurrence of its component (by
    doc_id, then place). component_id is the smallest doc_id reachable over shared paragraphs and
    passages; of a document that shares nothing, its own. Rows without an id or a text
    share nothing (component_id: the id). Paragraphs of fewer than ``min_words`` words and passages of fewer than
    PASSAGE bytes are not compared. Rows equal in id and text give one row; other columns are
    ignored.
    """
    source = _source(docs, id_col, text_col)
    found = checkpointed(paragraph_groups(source, min_words, similarity).unionByName(passage_groups(source)).distinct())
    own = F.struct("doc_id", "th", "start")
    classes = connected_components(found.select(F.col("doc_id").alias("a"), F.col("first.doc_id").alias("b")))
    found = found.select("doc_id", "th", F.struct("start", "stop", (F.col("first") != own).alias("gone")).alias("span"))
    each = found.groupBy("doc_id", "th").agg(F.collect_list("span").alias("spans"))
    spans = "array<struct<start:long,stop:long>>"

    @F.pandas_udf(f"shared {spans}, removed {spans}")
    def merge(column: pd.Series) -> pd.DataFrame:
        out = []
        for x in column:
            pairs = [[{"start": a, "stop": b} for a, b in merged_spans([s["start"] for s in x if s["gone"] or every], [s["stop"] for s in x if s["gone"] or every])] for every in (True, False)]
            out.append(pairs)
        return pd.DataFrame(out, columns=["shared", "removed"])

    each = each.withColumn("m", merge("spans")).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "m.shared", "m.removed")
    classes = classes.select(F.col("node").alias("c"), "component")
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("th")).distinct()
    every = every.join(each, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t")), "left").join(classes, F.col("doc_id") == F.col("c"), "left")
    none = F.array().cast(spans)
    every = every.select("doc_id", F.coalesce("shared", none).alias("shared"), F.coalesce("removed", none).alias("removed"), F.coalesce("component", "doc_id").alias("component_id"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return every.select("doc_id", "shared", "removed", n.alias("n_removed"), "component_id")
