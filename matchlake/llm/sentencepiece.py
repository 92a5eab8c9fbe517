"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

The merges of byte-pair encoding are local: if every two neighbours of a token sequence
encode to themselves when they stand alone, the sequence is the encoding of the whole
text, and every prefix of the text has exactly one token that its encoding ends
with. So one pass with an automaton over all vocabulary matches fills a table with each
prefix's last token - the match that is compatible with the last token of the prefix before
it - and the ids are read off backwards. Time is linear in the text.
"""

from __future__ import annotations

import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import pieces

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Entries that each of a worker's memo tables may hold; a full table is set aside for the next one's misses.
MEMO = 100_000


def _fields(data: bytes):
    """(field, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """A BPE model file's vocabulary with exact encoding and decoding.

    Takes models with byte fallback and the identity normaliser (spaces escaped, none
    removed); others raise ValueError.
    """

    def __init__(self, model: bytes):
        self.texts, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        self.prefix = bool(normalizer.get(3, 1))
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models with byte fallback and without normalisation rules are supported")
        self.byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == BYTE}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == NORMAL}
        self.eos = self.texts.index("</s>")
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.chars = {t for t in self.ids if len(t) == 1}
        if any(not self.chars.issuperset(t) for t in self.ids) or any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece holds a character that is no piece, or a space after other characters")
        # No piece spans these cuts, so the parts between them are encoded on their own and remembered.
        cut = "".join(c for c in "\t\n\r" if c not in self.chars)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{cut}]*|[^{SPACE}{cut}]+" + (f"|[{cut}]" if cut else "")).findall
        self.raw = [bytes([int(t[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, self.kinds)]
        self.seen: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """The merges themselves, best score first and leftmost among equals; for short texts."""
        symbols, ids, scores = list(text), self.ids, self.scores
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                j = ids.get(symbols[i] + symbols[i + 1])
                if j is not None and (best is None or scores[j] > best):
                    best, at = scores[j], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Do the two pieces stay as they are when their texts are encoded together? left -1: right alone."""
        key = (left + 1) * len(self.texts) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO * 3:
                self.pairs.clear()
            own = ([] if left < 0 else [self.texts[left]]) + [self.texts[right]]
            known = self.pairs[key] = self.merge("".join(own)) == own
        return known

    def encode_part(self, text: str) -> tuple[int, ...]:
        n = len(text)
        last = [-2] * (n + 1)  # the last token of each prefix; -1: none, what follows stands alone
        last[0] = -1
        if not self.chars.issuperset(text):
            for i, c in enumerate(text):
                if c not in self.chars:
                    last[i + 1] = -1
        pairs, wide, compatible = self.pairs, len(self.texts), self.compatible
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] == -2 and (before := last[end + 1 - size]) != -2:
                known = pairs.get((before + 1) * wide + token)
                if known or known is None and compatible(before, token):
                    last[end + 1] = token
        out, at = [], n
        while at:
            token = last[at]
            if token < 0:
                at -= 1
                out.extend(self.byte_ids[b] for b in reversed(text[at].encode()))
            else:
                out.append(token)
                at -= len(self.texts[token])
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without an end id."""
        if not text:
            return []
        out, seen = [], self.seen
        for part in self.parts((SPACE if self.prefix else "") + text.replace(" ", SPACE)):
            ids = seen.get(part)
            if ids is None:
                ids = self.older.get(part) or self.encode_part(part)
                if len(part) <= 64:
                    if len(seen) >= MEMO:
                        self.older, self.seen = seen, {}
                        seen = self.seen
                    seen[part] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces and fallback bytes joined, without the space put before the text."""
        out = b"".join(map(self.raw.__getitem__, ids))
        if self.prefix and out[:1] == b" " and next((self.kinds[i] for i in ids if self.kinds[i] != CONTROL), None) == NORMAL:
            out = out[1:]
        return out.decode("utf-8", "replace")


_loaded: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    """The worker's own copy, loaded once, so that what it remembers serves later tasks."""
    key = hash(data)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceModel(data)
    return _loaded[key]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_eos: bool = True) -> DataFrame:
    """(doc_id, ids array<int>, decoded) for every row: the whole text's ids and what they decode to.

    A null text counts as empty and has the end id only. Null ids and repeated rows come
    back as they are; other columns are ignored. The model file (under 1 MB) is read on the
    driver and travels with the tasks.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    if len(model) > 32 << 20:
        raise ValueError("the model file is too large to travel with the tasks")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = _model(shared.value)
        for batch in pieces(batches, rows=512, limit=8 << 20):
            offsets, parts, decoded = [0], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                decoded.append(own.decode(ids))
                if add_eos:
                    ids.append(own.eos)
                parts.append(np.array(ids, np.int32))
                offsets.append(offsets[-1] + len(ids))
            values = np.concatenate(parts) if parts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)), pa.array(decoded, pa.string())], schema=_ENCODED)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
