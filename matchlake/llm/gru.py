"""Language-model scoring with a gated recurrent network and a class-factored softmax.

Counts of every training word come from the whole corpus. The commonest words have output
rows of their own, in classes; the others are grouped in tail classes by their last two bytes, and a tail word's
share of its class is its smoothed count. So the probability of a token is
P(class | state) * P(word | class, state) for common words and P(class | state) * share for
the tail. Weights are trained by truncated backpropagation in numpy, by each task on its texts; the
tasks' weights are averaged after each round. When a text is
scored the state is carried from its first token to its end, whatever its length.
"""

from __future__ import annotations

import copy
import functools
import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import checkpointed, pieces

END = b"\n"  # no word holds it
CLASSES, CLASS_WORDS, TAILS = 64, 64, 32
COMMON = CLASSES * CLASS_WORDS
#: Most frequent words whose counts every task has at hand; the counts of the rest are joined.
AT_HAND = 65_536
#: Rounds of training, and the share of the training texts that each round sees, by a hash of the id: all are seen once.
ROUNDS, SHARE = 2, 2
#: Training tokens of a task, about; bytes of text that are trained on at a time; floats of a block of weights that is averaged.
TASK_TOKENS, PIECE, BLOCK = 1_000_000, 4 << 20, 1024
HIDDEN, EMBED, LANES, WINDOW = 32, 24, 256, 16
#: Weights that are updated at a time: their gradient and means stay in the cache.
ADAM_BLOCK = 32_768
#: Updates that a piece of text is trained in at least, by fewer lanes.
UPDATES = 64


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


@functools.cache
def _tail_tables() -> tuple[np.ndarray, np.ndarray]:
    """tail_of by a word's only byte, and by its last two."""
    ends = [bytes((a, b)) for a in range(256) for b in range(256)]
    return np.array([tail_of(w[:1]) for w in ends[::256]], np.int32), np.array([tail_of(w) for w in ends], np.int32)


def tails_of(words: pa.Array) -> np.ndarray:
    """tail_of each word; none is empty."""
    if not len(words):
        return np.zeros(0, np.int32)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last, one, two = data[ends[1:] - 1].astype(np.int32), *_tail_tables()
    return np.where(np.diff(ends) > 1, two[data[np.maximum(ends[1:] - 2, 0)].astype(np.int32) * 256 + last], one[last])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, owner, sizes): the words that ``tokens`` gives of all texts, end to end and without ends, the place of each one's text, and each text's number of tokens."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
    words = parts.flatten().view(pa.binary())
    full = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty word there
    if not pc.all(full, min_count=0).as_py():
        words, owner = words.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    return words, owner, np.bincount(owner, minlength=len(texts)) + 1


def places_in(words: pa.Array, hand: pa.Array) -> np.ndarray:
    """The place of each word in ``hand``; -1: in none."""
    return pc.fill_null(pc.index_in(words, hand), -1).to_numpy(zero_copy_only=False)


def sequences(words: pa.Array, owner: np.ndarray, sizes: np.ndarray, place: np.ndarray, model_ids: np.ndarray) -> list[np.ndarray]:
    """The model's ids of each text; model_ids: by place, with one more at the end. A word in no place has its tail class."""
    ids = model_ids[place]
    away = np.flatnonzero(place < 0)
    ids[away] = COMMON + tails_of(words.take(pa.array(away)))
    out = np.zeros(int(sizes.sum()), np.int32)  # the end has id 0
    out[np.arange(len(ids)) + owner] = ids
    return np.split(out, np.cumsum(sizes)[:-1])


def _bounded(weights: np.ndarray, bias: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights with the biases as a last column, less the most that a logit can be after ``states``; whether rows need their own peaks all the same).

    weights: (..., words, HIDDEN). With that bound no row's peak is looked for, unless exp might wipe a whole row out.
    """
    span = np.sqrt(np.einsum("...i,...i->...", weights, weights) * np.einsum("ij,ij->i", states, states).max(initial=0))
    top = (bias + span).max(axis=-1, keepdims=True)
    return np.concatenate((weights, (bias - top)[..., None]), axis=-1), top[..., 0] - (bias - span).max(axis=-1) > 60


def _log_softmax(logits: np.ndarray, far: bool, at: np.ndarray) -> np.ndarray:
    """Log softmax of each row at one place; works in place. far: rows need their own peaks."""
    if far:
        logits -= logits.max(axis=1, keepdims=True)
    out = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return out - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def _soft_error(logits: np.ndarray, at: np.ndarray, each: np.float32) -> np.ndarray:
    """Softmax of each row less the target, times ``each``; works in place."""
    np.exp(logits, out=logits)
    logits *= each / (logits @ np.ones((logits.shape[1], 1), logits.dtype))
    logits[np.arange(len(at)), at] -= each
    return logits


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Places of common words in the order of their classes, and where each class begins."""
    cuts = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=CLASSES)[:CLASSES])))
    return np.argsort(cls.astype(np.uint8), kind="stable")[: cuts[-1]], cuts.tolist()


class GatedLM:
    """Gated recurrent unit over input ids; output: a class, then a word of a common class."""

    def __init__(self, word_counts: np.ndarray, tail_mass: np.ndarray, seed: int = 0):
        """word_counts: counts of the common words in order (COMMON at most); tail_mass: of each tail class."""
        rng = np.random.default_rng(seed)
        f = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
        counts = np.zeros(COMMON)
        counts[: len(word_counts)] = word_counts
        counts = counts.reshape(CLASSES, CLASS_WORDS)
        there = (np.arange(COMMON) < len(word_counts)).reshape(CLASSES, CLASS_WORDS)
        mass = np.concatenate((np.where(there, counts + 0.5, 0).sum(axis=1), tail_mass))
        self.p = {
            "E": f(COMMON + TAILS, EMBED, by=0.1), "Wx": f(EMBED, 3 * HIDDEN, by=EMBED**-0.5), "Wh": f(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), "b": np.zeros(3 * HIDDEN, np.float32),
            "Wc": np.zeros((HIDDEN, CLASSES + TAILS), np.float32), "bc": np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), -1e9).astype(np.float32),
            "U": np.zeros((CLASSES, CLASS_WORDS, HIDDEN), np.float32), "bu": np.where(there, np.log(counts + 0.5), -1e9).astype(np.float32),
        }

    # ids: 0..COMMON-1 common words, then tail classes; a text's input begins with the end token.

    def _step(self, gx, h):
        # states lie unit by unit, the lanes of a unit side by side: its gates are contiguous
        gh = (self.p["Wh"].T @ h.T).T
        zr = gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN]
        np.exp(np.negative(zr, out=zr), out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, ghn = zr[:, :HIDDEN], zr[:, HIDDEN:], gh[:, 2 * HIDDEN :]
        n = r * ghn
        n += gx[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        after = h - n
        after *= z
        after += n
        return z, r, n, ghn, after

    def log_probs(self, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log probability of each id (a tail id: of its class) after the states ``h``."""
        common = ids < COMMON
        cls = np.where(common, ids // CLASS_WORDS, ids - COMMON + CLASSES)
        rows = np.ones((len(h), HIDDEN + 1), h.dtype)
        rows[:, :HIDDEN] = h
        weights, far = _bounded(self.p["Wc"].T, self.p["bc"], rows[:, :HIDDEN])
        out = np.empty(len(ids))
        for at in range(0, len(ids), 2048):  # as many as stay in the cache
            out[at : at + 2048] = _log_softmax(rows[at : at + 2048] @ weights.T, far, cls[at : at + 2048])
        by, cuts = _by_class(cls)
        rows, words = rows[by], (ids % CLASS_WORDS)[by]
        weights, far = _bounded(self.p["U"], self.p["bu"], rows[:, :HIDDEN])
        found = np.empty(len(by))
        for k in range(CLASSES):
            lo, hi = cuts[k], cuts[k + 1]
            if hi > lo:
                found[lo:hi] = _log_softmax(rows[lo:hi] @ weights[k].T, far[k], words[lo:hi])
        out[by] += found
        return out

    def score(self, texts: list[np.ndarray], lanes: int = 512, window: int = 32) -> np.ndarray:
        """Natural log probability of each text (ids ending with the end token).

        Texts are laid end to end in lanes, the longest first; a lane's state is carried to its end
        and cleared where a text begins.
        """
        total = np.zeros(len(texts))
        if not texts:
            return total
        heap = [(0, i) for i in range(min(lanes, len(texts)))]
        line: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
            size, lane = heapq.heappop(heap)
            line[lane].append(i)
            heapq.heappush(heap, (size + len(texts[i]), lane))
        line.sort(key=lambda x: -sum(len(texts[i]) for i in x))
        sizes = np.array([sum(len(texts[i]) for i in x) for x in line])
        steps = int(sizes[0])
        ids = np.zeros((steps, len(line)), np.int32)
        owner = np.zeros((steps, len(line)), np.int32)
        fresh = np.zeros((steps, len(line)), bool)
        for lane, x in enumerate(line):
            at = 0
            for i in x:
                n = len(texts[i])
                ids[at : at + n, lane], owner[at : at + n, lane], fresh[at, lane] = texts[i], i, True
                at += n
        table, weights = np.concatenate((self.p["E"], np.ones((len(self.p["E"]), 1), np.float32)), axis=1), np.concatenate((self.p["Wx"], self.p["b"][None]))
        h = np.zeros((HIDDEN, len(line)), np.float32).T
        before = np.zeros(len(line), np.int32)  # the end token has id 0
        states, wants, owners, held = [], [], [], 0
        lives = np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()  # lanes that are longer than t
        for t, live in enumerate(lives):
            new = fresh[t, :live]
            h, before = h[:live], before[:live]
            if new.any():
                h = np.where(new, np.float32(0), h.T).T
                before = np.where(new, 0, before)
            h = self._step((weights.T @ table[before].T).T, h)[4]
            before = ids[t, :live]
            states.append(h)
            wants.append(before)
            owners.append(owner[t, :live])
            held += live
            # as many states at a time as full lanes have in a window: a long text's few lanes take more steps
            if held >= lanes * window or t + 1 == steps:
                total += np.bincount(np.concatenate(owners), self.log_probs(np.concatenate(states), np.concatenate(wants)), len(texts))
                states, wants, owners, held = [], [], [], 0
        return total

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)])

    def load(self, weights: np.ndarray, shared: bool = False) -> None:
        """shared: the model's weights are parts of ``weights`` and change with them."""
        at = 0
        for k in sorted(self.p):
            self.p[k] = weights[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32, copy=not shared)
            at += self.p[k].size

    def train(self, texts: list[np.ndarray], epochs: int = 1, rate: float = 4e-3, lanes: int = LANES, window: int = WINDOW, seed: int = 0) -> None:
        """Truncated backpropagation through windows, Adam; the state runs on between windows, and Adam's means between calls."""
        texts = [t for t in texts if len(t)]
        if not texts:
            return
        rng = np.random.default_rng(seed)
        w = self.flat()
        if not hasattr(self, "adam"):
            self.adam = np.zeros_like(w), np.zeros_like(w), [0]
        first, second, updates = self.adam
        room = np.empty(min(len(w), ADAM_BLOCK), np.float32)
        self.load(w, shared=True)
        for _ in range(epochs):
            stream = np.concatenate([texts[i] for i in rng.permutation(len(texts))])
            lanes_ = max(1, min(lanes, len(stream) // (window * UPDATES)))
            width = -(-len(stream) // lanes_)
            # the last lane is filled up from the first
            target = np.resize(stream, lanes_ * width).reshape(lanes_, width)
            given = np.concatenate((np.zeros((lanes_, 1), np.int32), target[:, :-1]), axis=1)
            h = np.zeros((lanes_, HIDDEN), np.float32)
            for at in range(0, width, window):
                g, h = self._gradient(given[:, at : at + window], target[:, at : at + window], h)
                updates[0] += 1
                flat = np.concatenate([g[k].reshape(-1) for k in sorted(g)])
                a, b = 1 - 0.9 ** updates[0], 1 - 0.99 ** updates[0]
                by = 0.1 * min(1.0, 5.0 / (math.sqrt(float(np.vdot(flat, flat))) + 1e-12))
                for lo in range(0, len(w), ADAM_BLOCK):
                    part = slice(lo, lo + ADAM_BLOCK)
                    x, m, v = flat[part], first[part], second[part]
                    x *= np.float32(by)
                    m *= np.float32(0.9)
                    m += x
                    # 0.1 squared is the share of the new square
                    x *= x
                    v *= np.float32(0.99)
                    v += x
                    own = np.sqrt(v, out=room[: len(v)])
                    own += np.float32(1e-6 * math.sqrt(b))
                    np.divide(m, own, out=own)
                    own *= np.float32(rate * math.sqrt(b) / a)
                    w[part] -= own

    def _gradient(self, given: np.ndarray, target: np.ndarray, h: np.ndarray):
        p, kind = self.p, self.p["Wh"].dtype
        lanes, steps = given.shape
        ids = given.T.reshape(-1)
        x = p["E"][ids].reshape(steps, lanes, EMBED)
        gx = p["Wx"].T @ x.transpose(0, 2, 1)  # of each step: units, then lanes
        gx += p["b"][:, None]
        begins = given == 0  # a text begins: its state is clear
        kept, flat = [], np.ones((steps, lanes, HIDDEN + 1), kind)
        h = np.asfortranarray(h)
        for t in range(steps):
            new = begins[:, t] if begins[:, t].any() else None
            if new is not None:
                h = np.where(new, np.float32(0), h.T).T
            z, r, n, ghn, after = self._step(gx[t].T, h)
            kept.append((h.T, z.T, r.T, n.T, ghn.T, new))
            flat[t, :, :HIDDEN] = h = after
        flat, want = flat.reshape(-1, HIDDEN + 1), target.T.reshape(-1)
        cls = np.where(want < COMMON, want // CLASS_WORDS, want - COMMON + CLASSES)
        g = {}
        each = np.float32(1 / len(want))
        weights, far = _bounded(p["Wc"].T, p["bc"], flat[:, :HIDDEN])
        soft = flat @ weights.T
        if far:
            soft -= soft.max(axis=1, keepdims=True)
        _soft_error(soft, cls, each)
        both = flat.T @ soft
        g["Wc"], g["bc"] = both[:HIDDEN], both[HIDDEN]
        dflat = soft @ p["Wc"].T
        by, cuts = _by_class(cls)
        rows = flat[by]
        weights, far = _bounded(p["U"], p["bu"], flat[:, :HIDDEN])
        soft, back, both = np.empty((len(by), CLASS_WORDS), kind), np.empty((len(by), HIDDEN), kind), np.zeros(weights.shape, kind)
        there = [(k, slice(cuts[k], cuts[k + 1])) for k in range(CLASSES) if cuts[k + 1] > cuts[k]]
        for k, own in there:
            np.matmul(rows[own], weights[k].T, out=soft[own])
            if far[k]:
                soft[own] -= soft[own].max(axis=1, keepdims=True)
        _soft_error(soft, want[by] % CLASS_WORDS, each)
        for k, own in there:
            np.matmul(soft[own].T, rows[own], out=both[k])
            np.matmul(soft[own], p["U"][k], out=back[own])
        g["U"], g["bu"] = both[..., :HIDDEN], both[..., HIDDEN]
        dflat[by] += back
        dstate = np.ascontiguousarray(dflat.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1))
        dh = np.zeros((HIDDEN, lanes), kind)
        to_x, to_h = np.empty((steps, 3 * HIDDEN, lanes), kind), np.empty((3 * HIDDEN, lanes), kind)
        g["Wh"] = np.zeros(p["Wh"].shape, kind)
        for t in range(steps - 1, -1, -1):
            hb, z, r, n, ghn, new = kept[t]
            dh += dstate[t]
            dz, dr, dn = to_x[t, :HIDDEN], to_x[t, HIDDEN : 2 * HIDDEN], to_x[t, 2 * HIDDEN :]
            rest = 1 - z
            rest *= dh
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= rest
            np.subtract(hb, n, out=dz)
            dz *= z
            dz *= rest
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= ghn
            dr *= dn
            to_h[: 2 * HIDDEN] = to_x[t, : 2 * HIDDEN]
            np.multiply(dn, r, out=to_h[2 * HIDDEN :])
            g["Wh"] += hb @ to_h.T
            dh *= z
            dh += p["Wh"] @ to_h
            if new is not None:
                dh[:, new] = 0
        g["Wx"] = (x.transpose(0, 2, 1) @ to_x.transpose(0, 2, 1)).sum(axis=0)
        g["b"] = (to_x @ np.ones(lanes, kind)).sum(axis=0)
        by = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[by]
        cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        g["E"] = np.zeros(p["E"].shape, kind)
        g["E"][ids[cuts]] = np.add.reduceat((to_x.transpose(0, 2, 1) @ p["Wx"].T).reshape(-1, EMBED)[by], cuts, axis=0)
        return g, h


_COUNTED = pa.schema([("word", pa.binary()), ("n", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all rows' tokens, ends included."""

    def run(batches):
        for batch in pieces(batches, rows=1 << 20, limit=16 << 20):
            words = split_words(batch.column(0))[0]
            found = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field(0), pa.array([END])]), pa.concat_arrays([found.field(1), pa.array([batch.num_rows])])], schema=_COUNTED)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_count(counts: DataFrame) -> int:
    """The count from which words are at hand: as many classes of like counts as hold AT_HAND words at most."""
    classes = counts.groupBy(F.floor(F.log2("n") * 16).alias("c")).agg(F.count("*").alias("words"), F.min("n").alias("low")).collect()
    total, low = 0, 1 << 62
    for r in sorted(classes, key=lambda r: -r["c"]):
        total += r["words"]
        if total > AT_HAND:
            break
        low = r["low"]
    return low


_WEIGHTS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("tokens", pa.float64()), ("v", pa.list_(pa.float32()))])
_WEIGHTS_SQL = "block int, part int, tokens double, v array<float>"


def _summed(table: pa.Table) -> pa.Table:
    """One row: the sums of a block's rows, which hold weights times tokens."""
    v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    own = [table["block"][0].as_py()], [table["part"][0].as_py()], [float(np.sum(table["tokens"].to_numpy()))], [v.sum(axis=0, dtype=np.float64).astype(np.float32)]
    return pa.table([pa.array(x, f.type) for x, f in zip(own, _WEIGHTS)], schema=_WEIGHTS)


def train_on(learn: DataFrame, model: GatedLM, ids: dict[bytes, int], tokens_in_all: int, rounds: int = ROUNDS, share: int = SHARE) -> None:
    """Train ``model`` in place: each round, tasks start from its weights and train on their part of one ``share``-th of ``learn``
    (text, doc_id), and the means of their weights, by tokens, become the model's. Whole texts of any length take part."""
    spark = learn.sparkSession
    tasks = max(1, tokens_in_all // share // TASK_TOKENS)
    for no in range(rounds):
        shared = spark.sparkContext.broadcast((model, ids))
        some = learn.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == no % share).select("text").coalesce(tasks)

        def run(batches, shared=shared, no=no):
            model, ids = shared.value
            model = copy.deepcopy(model)
            hand, model_ids = pa.array(list(ids), pa.binary()), np.array([*ids.values(), 0], np.int32)
            n = 0
            for batch in pieces(batches, rows=1 << 20, limit=PIECE):
                words, owner, sizes = split_words(batch.column(0))
                model.train(sequences(words, owner, sizes, places_in(words, hand), model_ids), seed=no)
                n += int(sizes.sum())
            if n:
                weights = (model.flat() / np.float32(1e6)) * np.float32(n)
                blocks = [weights[at : at + BLOCK] for at in range(0, len(weights), BLOCK)]
                part = TaskContext.get().partitionId() % 64
                yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([n / 1e6] * len(blocks), pa.float64()), pa.array(blocks, pa.list_(pa.float32()))], schema=_WEIGHTS)

        rows = some.mapInArrow(run, _WEIGHTS_SQL).groupBy("block", "part").applyInArrow(_summed, _WEIGHTS_SQL)
        found = rows.groupBy("block").applyInArrow(_summed, _WEIGHTS_SQL).collect()  # the weights of one model
        if found:
            model.load(np.concatenate([np.array(r["v"], np.float64) / r["tokens"] for r in sorted(found, key=lambda r: r["block"])]))


def score_documents(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, share: int = SHARE) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row's whole text.

    ``training`` is the boolean column that marks the rows to learn from; null counts as
    no. Null texts are empty texts: one token, the end. base_score is the smoothed unigram
    log10 probability, score the model's. Nothing to learn from: the end and the tail classes are
    equally likely, no token is known. All counts cover every training row; the weights are trained on
    ``rounds`` of ``share`` parts of the training rows, whole texts, on the executors. Repeated rows come
    back repeated; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learn = source.where("training").select("text", "doc_id")
    counts = checkpointed(word_counts(learn))
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = int(total or 0), int(distinct or 0)
    unit = total + 0.5 * (distinct + 1)
    hand = [(bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= least_count(counts)).collect()]  # at most AT_HAND
    hand.sort(key=lambda x: (-x[1], x[0]))
    ends = next((n for w, n in hand if w == END), 0) or (counts.where(F.col("word") == F.lit(END)).agg(F.sum("n")).first()[0] or 0)
    common = [(END, ends), *[x for x in hand if x[0] != END][: COMMON - 1]]
    tail_class = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(TAILS)).cast("int")
    mass = np.full(TAILS, 0.5)  # a word not seen in training
    for r in counts.groupBy(tail_class.alias("tail")).agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():
        mass[r["tail"]] += r["mass"]
    for w, n in common:
        if n:
            mass[tail_of(w)] -= n + 0.5
    mass = np.maximum(mass, 0.5)
    ids = {w: i for i, (w, _) in enumerate(common)}
    rest = {w: n for w, n in hand if w not in ids}
    model = GatedLM(np.array([n for _, n in common]), mass)
    # what a task has at hand of a word: the model's id, base log probability, and what its share of its tail class adds
    known_words = [*common, *rest.items()]
    counts_of = np.array([n for _, n in known_words], np.float64)
    tails = np.array([tail_of(w) for w, _ in known_words])
    place = np.arange(len(known_words))
    is_common = place < len(common)
    model_ids = np.where(is_common, place, COMMON + tails).astype(np.int32)
    base_logs = np.log10((counts_of + 0.5) / unit)
    shares = np.where(is_common, 0.0, np.log10(counts_of + 0.5) - np.log10(mass)[tails])
    at_hand = [w for w, _ in known_words]
    train_on(learn, model, dict(zip(at_hand, model_ids.tolist())), total, rounds, share)
    # the last of each is that of words that are not at hand
    shared = spark.sparkContext.broadcast((model, at_hand, *(np.append(x, x.dtype.type(0)) for x in (model_ids, base_logs, shares, counts_of > 0)), np.log10(mass)))

    def run(batches):
        model, at_hand, model_ids, base_logs, shares, seen, log_mass = shared.value
        hand = pa.array(at_hand, pa.binary())
        for batch in pieces(batches, rows=10_000, limit=24 << 20):
            words, owner, sizes = split_words(batch.column(1))
            place, rows = places_in(words, hand), len(sizes)
            seqs = sequences(words, owner, sizes, place, model_ids)
            # the end stands first at hand
            base = base_logs[0] + np.bincount(owner, base_logs[place], rows)
            known = int(seen[0]) + np.bincount(owner, seen[place], rows).astype(np.int64)
            tail = np.bincount(owner, shares[place], rows)
            other = np.flatnonzero(place < 0)
            words, owner = words.take(pa.array(other)), owner[other]
            tail -= np.bincount(owner, log_mass[tails_of(words)], rows)
            words = words.dictionary_encode()
            each = max(1, len(words.dictionary))
            far, times = np.unique(owner.astype(np.int64) * each + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            cuts = pa.array(np.searchsorted(far, np.arange(rows + 1) * each), pa.int32())
            away, times = (pa.ListArray.from_arrays(cuts, x) for x in (words.dictionary.take(pa.array(far % each)), pa.array(times, pa.int32())))
            del words, owner, place, other, far
            score = model.score(seqs) / math.log(10) + tail
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), away, times], schema=_SCORED)

    scored = checkpointed(source.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double, rest array<binary>, times array<int>"))
    scored = scored.withColumn("row", F.monotonically_increasing_id())  # the same in every reading of the written table
    far = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    far = far.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("l", F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5))
    far = far.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum("l").alias("l"), F.sum("times").alias("times"))
    joined = scored.drop("rest", "times").join(far, "row", "left")
    more = F.coalesce("l", F.lit(0.0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.coalesce("times", F.lit(0)) * math.log10(unit)).alias("base_score"), (F.col("score") + more).alias("score"),
    )
