"""Suffix-array deduplication: bytes covered by a string of 100 bytes that starts earlier too.

Sorting every suffix of a corpus is not needed to find the repeated ones. Each window of
``width`` bytes is named by its anchor, the 50-byte string in it with the least hash;
equal windows have equal anchors at equal offsets, so only anchors that occur twice
are followed up. The suffixes that begin at these anchors, and the reversed texts
before them, are put in suffix-array order by deep-shallow sorting: multikey quicksort on
8-byte digits down to a shallow depth, then a blind trie for each group that still
shares its prefix. Neighbours' common prefixes then tell, for every offset, which windows are
equal and which of them is the first. All comparisons are of bytes; hashes only
choose what is compared.

Texts are dealt into buckets once; that exchange is read three times (anchors,
contexts, removal). What travels between tasks are packed arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 100
#: Length of an anchor; a window has WIDTH - GRAM + 1 of them.
GRAM = 50
#: Depth of the multikey quicksort, in bytes; groups that share more go to a blind trie.
SHALLOW = 16
#: Bytes of text that are hashed at a time.
BLOCK = 4 << 20
#: Bytes of text of one bucket, about.
BUCKET_BYTES = 64 << 20
#: Copies of one text spread over this many buckets at most.
SPREAD = 16
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LAST = np.iinfo(np.int64).max


# ---------------------------------------------------------------- anchors


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_cache: dict[str, np.ndarray] = {}


def _hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each ``gram`` bytes."""
    n = len(data)
    if len(_cache.get("up", ())) < n + 1:
        _cache["up"], _cache["down"] = _powers(_BASE, n + 1), _powers(_BASE_INVERSE, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _cache["down"][:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * _cache["up"][: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _leftmost_min(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the leftmost least value in each window of ``size``."""
    low, place, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < size:
        step = min(have, size - have)
        left, right = slice(0, len(low) - step), slice(step, None)
        first = low[left] <= low[right]
        place = np.where(first, place[left], place[right])
        low = np.minimum(low[left], low[right])
        have += step
    return place


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM):
    """(text no, place, first window start, last window start, hash) of each text's anchors."""
    out = [(np.empty(0, np.int32),) + (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)]
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for no, text in enumerate([*texts, None]):
        if size and (text is None or size + len(text) > BLOCK):
            out.append(_anchors_of(part, width, gram))
            part, size = [], 0
        if text is None or len(text) < width:
            continue
        for at in range(0, len(text) - width + 1, BLOCK):  # a long text's parts overlap by all but one byte of a window
            own = text[at : at + BLOCK + width - 1]
            part.append((no, at, own))
            size += len(own)
            if size > BLOCK:
                out.append(_anchors_of(part, width, gram))
                part, size = [], 0
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors_of(part: list[tuple[int, int, bytes]], width: int, gram: int):
    data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
    sizes = np.array([len(p) for _, _, p in part], np.int64)
    begin = np.cumsum(sizes) - sizes
    h = _hashes(data, gram)
    place = _leftmost_min(h, width - gram + 1)
    starts = np.arange(len(place))
    owner = np.repeat(np.arange(len(part)), sizes)[: len(place)]
    inside = starts + width <= (begin + sizes)[owner]
    starts, place, owner = starts[inside], place[inside], owner[inside]
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(place)] - 1
    own, q = owner[new], place[new].astype(np.int64)
    shift = np.array([at for _, at, _ in part], np.int64)[own] - begin[own]
    return np.array([no for no, _, _ in part], np.int32)[own], q + shift, starts[new] + shift, starts[last] + shift, h[q]


# ---------------------------------------------------------------- deep-shallow sorting


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Places of equally long strings in sorted order, by insertion into a blind trie.

    An inner node keeps only the depth it branches at and its branches' bytes; a string
    walks down without being compared, and one comparison with the leaf it meets tells
    where it belongs.
    """
    root: list = [strings[0], [0]]  # a leaf: its string, who has it; an inner node: depth, byte -> node
    for no in range(1, len(strings)):
        s, node = strings[no], root
        while type(node[0]) is int:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[0] == s:
            node[1].append(no)
            continue
        differ = int.from_bytes(node[0]) ^ int.from_bytes(s)
        depth = len(s) - (differ.bit_length() + 7) // 8
        other, above, node = node[0][depth], None, root
        while type(node[0]) is int and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if type(node[0]) is int and node[0] == depth:
            node[1][s[depth]] = [s, [no]]
            continue
        inner = [depth, {other: node, s[depth]: [s, [no]]}]
        if above is None:
            root = inner
        else:
            above[1][s[above[0]]] = inner
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node[0]) is int:
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(node[1])
    return out


def deep_shallow_order(rows: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows of a byte matrix: multikey quicksort to ``shallow`` bytes, then blind tries."""
    n, wide = rows.shape
    order, group = np.arange(n), np.zeros(n, np.int64)
    for at in range(0, min(shallow, wide), 8):
        digit = rows[order, at : at + 8]
        if digit.shape[1] < 8:
            digit = np.pad(digit, ((0, 0), (0, 8 - digit.shape[1])))
        digit = np.ascontiguousarray(digit).view(">u8").reshape(-1).astype(np.uint64)
        by = np.lexsort((digit, group))
        order, group, digit = order[by], group[by], digit[by]
        group = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
    if wide > shallow and n:
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                own = order[lo:hi]
                tails = rows[own, shallow:].tobytes()
                step = wide - shallow
                order[lo:hi] = own[blind_trie_order([tails[i : i + step] for i in range(0, len(tails), step)])]
    return order


def classes(rows: np.ndarray):
    """f(depth): for each row a number that rows with the same first ``depth`` bytes share."""
    order = deep_shallow_order(rows)
    common = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 1 << 15):
        some = order[at - 1 : at + (1 << 15)]
        differ = rows[some[1:]] != rows[some[:-1]]
        common[at : at + (1 << 15)] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    back = np.empty(len(rows), np.int64)
    back[order] = np.arange(len(rows))
    return lambda depth: np.cumsum(common < depth)[back]


def repeated(left: np.ndarray, right: np.ndarray, least: np.ndarray, most: np.ndarray, doc: np.ndarray, pos: np.ndarray, width: int = WIDTH):
    """Least and greatest offset at which each anchor's window is a repeat of an earlier one; -1: none.

    Rows of ``left`` are the bytes before each anchor, reversed; of ``right`` those from
    the anchor on. Window offsets least..most of each are valid. Earlier is by (doc, pos).
    """
    n, span = len(doc), left.shape[1]
    low, high = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if not n:
        return low, high
    by = np.lexsort((pos, doc))
    left, right, least, most, doc, pos = left[by], right[by], least[by], most[by], doc[by], pos[by]
    before, after = classes(left), classes(right)
    for offset in range(span + 1):
        valid = np.flatnonzero((least <= offset) & (offset <= most))
        if len(valid) < 2:
            continue
        key = after(width - offset)[valid] * (n + 1) + before(offset)[valid]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        first = valid[first[which]]
        # windows at one offset start at pos - offset, so (doc, pos) orders them
        later = valid[(doc[valid] != doc[first]) | (pos[valid] != pos[first])]
        low[by[later]] = np.where(low[by[later]] < 0, offset, low[by[later]])
        high[by[later]] = offset
    return low, high


# ---------------------------------------------------------------- distributed plan

# a text has fewer than 2^31 bytes
_ANCHOR = np.dtype([("h", "<u8"), ("row", "<i4"), ("pos", "<u4")])
_REPLY = np.dtype([("row", "<i4"), ("pos", "<u4")])
_SPAN = np.dtype([("row", "<i4"), ("start", "<i8"), ("end", "<i8")])
_MEMBER = np.dtype([("h", "<u8"), ("bucket", "<i4"), ("row", "<i4"), ("doc", "<i8"), ("pos", "<i8"), ("least", "u1"), ("most", "u1"), ("text", "u1", (WIDTH + GRAM,))])
_SENT = pa.schema([("target", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
_SENT_SQL = "target int, bucket int, kind int, data binary"


def _send(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _SENT)], schema=_SENT)


def _split(array: np.ndarray, target: np.ndarray):
    """(target, bytes of its records)."""
    by = np.argsort(target, kind="stable")
    array, target = array[by], target[by]
    cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True]) if len(target) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(target[lo]), array[lo:hi].tobytes()


def _packed(member: np.ndarray) -> bytes:
    """Members with their contexts, ordered by anchor so that equal contexts meet, compressed."""
    return zstandard.compress(member[np.argsort(member["h"], kind="stable")].tobytes(), 1)


def _gather(table: pa.Table, dtype: np.dtype, kind: int = 0) -> np.ndarray:
    parts = [d for d, k in zip(table["data"].to_pylist(), table["kind"].to_pylist()) if k == kind]
    return np.frombuffer(b"".join([zstandard.decompress(d) for d in parts] if dtype == _MEMBER else parts), dtype)


def _rows(table: pa.Table):
    """(ids, texts, first): a bucket's rows in a fixed order, and for each the first row with its text."""
    ids = [_LAST if i is None else i for i in table["doc_id"].to_pylist()]
    texts = [t or b"" for t in table["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], hashlib.sha256(texts[i]).digest()))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    seen: dict[bytes, int] = {}
    return ids, texts, [seen.setdefault(t, i) for i, t in enumerate(texts)], order


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start,end>>, kept binary) for every row.

    spans are the maximal runs of bytes (end exclusive) covered by a 100-byte string that
    also starts earlier: in a document with a smaller id, or earlier in the same one. kept
    is the rest. Matches never cross documents; null texts are empty; null ids come
    last. Rows that share an id are no earlier than each other at the same start, so
    repeated rows keep the same bytes. Other columns are ignored.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    spark = docs.sparkSession
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    spread = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(SPREAD))
    dealt = source.withColumn("bucket", F.pmod(F.xxhash64("text", spread), F.lit(buckets)).cast("int"))

    def find(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        _, texts, first, _ = _rows(table)
        row, pos, _, _, h = anchors([t if first[i] == i else b"" for i, t in enumerate(texts)])
        found = np.empty(len(row), _ANCHOR)
        found["h"], found["row"], found["pos"] = h, row, pos
        return _send([(t, bucket, 0, d) for t, d in _split(found, (h % np.uint64(buckets)).astype(np.int64))])

    def twice(table: pa.Table) -> pa.Table:
        target = table["target"][0].as_py()
        parts, owner = [], []
        for bucket, data in zip(table["bucket"].to_pylist(), table["data"].to_pylist()):
            part = np.frombuffer(data, _ANCHOR)
            parts.append(part)
            owner.append(np.full(len(part), bucket, np.int64))
        found, owner = np.concatenate(parts), np.concatenate(owner)
        by = np.argsort(found["h"], kind="stable")
        h = found["h"][by]
        same = h[1:] == h[:-1]
        by = by[np.r_[False, same] | np.r_[same, False]]
        reply = np.empty(len(by), _REPLY)
        reply["row"], reply["pos"] = found["row"][by], found["pos"][by]
        return _send([(target, b, 0, d) for b, d in _split(reply, owner[by])])

    def contexts(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _send([])
        bucket = table["bucket"][0].as_py()
        ids, texts, _, _ = _rows(table)
        wanted = _gather(replies, _REPLY)
        wanted = wanted[np.lexsort((wanted["pos"], wanted["row"]))]
        out, spans = [], []
        for lo, hi in _blocks(wanted["row"], texts):
            rows = np.unique(wanted["row"][lo:hi])
            row, pos, start, stop, h = anchors([texts[r] for r in rows])
            row = rows[row].astype(np.int64)
            keep = np.isin((row << 32) | pos, (wanted["row"][lo:hi].astype(np.int64) << 32) | wanted["pos"][lo:hi].astype(np.int64))
            row, pos, start, stop, h = (x[keep] for x in (row, pos, start, stop, h))
            size = np.array([len(texts[r]) for r in rows])
            begin = np.cumsum(size) - size + WIDTH * np.arange(1, len(rows) + 1)
            data = np.frombuffer((b"\0" * WIDTH).join([b"", *[texts[r] for r in rows], b""]), np.uint8)
            member = np.empty(len(row), _MEMBER)
            member["h"], member["bucket"], member["row"], member["pos"] = h, bucket, row, pos
            member["doc"] = np.array(ids, np.int64)[row]
            member["least"], member["most"] = pos - stop, pos - start
            at = begin[np.searchsorted(rows, row)] + pos
            member["text"] = data[(at - GRAM)[:, None] + np.arange(WIDTH + GRAM)]
            out.append(member)
        member = np.concatenate(out)
        # One of those with equal contexts speaks for all: what it repeats, they repeat, and they repeat it.
        member = member[np.lexsort((member["pos"], member["doc"]))]
        packed = np.concatenate((member["text"], member["least"][:, None], member["most"][:, None]), axis=1)
        _, first, which = np.unique(packed.view(f"V{packed.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
        first = first[which]
        later = (member["doc"] != member["doc"][first]) | (member["pos"] != member["pos"][first])
        spans.append(_spans(member[later], member["least"][later], member["most"][later]))
        # the anchor's own 50 bytes choose the target again
        member = member[~later]
        target = (member["h"] % np.uint64(buckets)).astype(np.int64)
        sent = [(int(t), bucket, 0, _packed(member[target == t])) for t in np.unique(target)]
        return _send(sent + [(bucket, bucket, 1, s.tobytes()) for s in spans if len(s)])

    def order(table: pa.Table) -> pa.Table:
        target = table["target"][0].as_py()
        member = _gather(table, _MEMBER, 0)
        sent = [(target, b, 0, d) for b, k, d in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist()) if k == 1]
        if len(member):
            low, high = repeated(member["text"][:, GRAM - 1 :: -1], member["text"][:, GRAM:], member["least"].astype(np.int64), member["most"].astype(np.int64), member["doc"], member["pos"])
            hit = low >= 0
            sent += [(target, b, 0, d) for b, d in _split(_spans(member[hit], low[hit], high[hit]), member["bucket"][hit])]
        return _send(sent)

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts, first, order = _rows(table) if table.num_rows else ([], [], [], [])
        spans = _gather(found, _SPAN) if found.num_rows else np.empty(0, _SPAN)
        spans = spans[np.lexsort((spans["start"], spans["row"]))]
        cut = np.searchsorted(spans["row"], np.arange(len(ids) + 1))
        gone: dict[int, list[tuple[int, int]]] = {}
        result: list = [None] * len(ids)
        for i, text in enumerate(texts):
            if first[i] == i:
                gone[i] = _merged(spans[cut[i] : cut[i + 1]])
            runs = gone[first[i]]
            if ids[first[i]] < ids[i] and len(text) >= WIDTH:
                runs = [(0, len(text))]
            kept = b"".join(text[a:b] for a, b in zip([0, *[e for _, e in runs]], [*[s for s, _ in runs], len(text)]))
            result[order[i]] = (len(text), [{"start": s, "end": e} for s, e in runs], kept)
        columns = list(zip(*result)) if result else [[]] * 3
        return pa.table([table["doc_id"] if table.num_rows else pa.array([], pa.int64()), *[pa.array(list(c), f.type) for c, f in zip(columns, list(_RESULT)[1:])]], schema=_RESULT)

    asked = dealt.groupBy("bucket").applyInArrow(find, _SENT_SQL).groupBy("target").applyInArrow(twice, _SENT_SQL)
    members = dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(contexts, _SENT_SQL)
    spans = members.groupBy("target").applyInArrow(order, _SENT_SQL)
    return dealt.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(remove, _RESULT_SQL)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_RESULT_SQL = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _blocks(row: np.ndarray, texts: list[bytes]):
    """Ranges of the sorted ``row`` whose texts have about BLOCK bytes."""
    cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if len(row) else np.array([0])
    lo, size = 0, 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        size += len(texts[row[a]])
        if size > BLOCK:
            yield lo, b
            lo, size = b, 0
    if lo < len(row):
        yield lo, len(row)


def _spans(member: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Windows at offsets low..high before an anchor overlap: one run of bytes each."""
    out = np.empty(len(member), _SPAN)
    out["row"], out["start"], out["end"] = member["row"], member["pos"] - high, member["pos"] - low + WIDTH
    return out


def _merged(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in zip(spans["start"].tolist(), spans["end"].tolist()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out
