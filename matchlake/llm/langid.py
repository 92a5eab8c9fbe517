"""Language identification by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from matchlake.llm._common import as_batch, checkpointed, pieces

#: n-grams of 1 to 3 letters; a word's start and end count as a letter (code 0).
PROFILE = 400
#: Documents of each language that the profiles are fitted on, about; taken by a hash of the id.
FIT_DOCS = 4000
UNDETERMINED = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams as 63-bit codes and their counts; none if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, 0).astype(np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]  # one boundary between words
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = (codes[:-1] << 21) | codes[1:] | (1 << 62)  # bit 62 tells pairs from triples that begin at a boundary
    three = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    three = three[codes[1:-1] != 0]
    return np.unique(np.concatenate((codes[codes != 0] | (1 << 61), two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties to the smaller code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Language profiles: sorted codes of all of them with each language's rank of the code."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(by_lang), size
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *by_lang.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)  # the last row: an unknown n-gram
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): least out-of-place distance, ties to the first language by name.

        The score is the winner's lead over the next language as a share of the next one's
        distance (one language: its closeness), between 0 and 1.
        """
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        top = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, top)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == top[known]
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        places = np.arange(len(top))[:, None]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - places)).sum(axis=0)
        best = int(np.argmin(distance))
        rest = np.delete(distance, best)
        next_best = rest.min() if len(rest) else self.size * len(top)
        return self.langs[best], float(min(1.0, max(0.0, 1 - distance[best] / next_best if next_best else 0.0)))


_COUNTED = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, fit_docs: int = FIT_DOCS) -> Profiles:
    """Profiles from rows with a text and a language; others are ignored.

    Fitted on about ``fit_docs`` documents of each language, or all if there are fewer:
    a bounded sample by the hash of the id, whole texts. Only the profiles (``size`` codes a
    language) reach the driver.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return Profiles({}, size)
    share = F.lit(0.0)
    for lang, n in per.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, fit_docs / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("fit")), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in pieces(batches):
            own: dict[str, list] = {}
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own.setdefault(lang, []).append(grams(text))
            for lang, found in own.items():
                total[lang] = _add([*found, *([total[lang]] if lang in total else [])])
        for lang, (codes, counts) in total.items():
            yield as_batch(_COUNTED, [lang] * len(codes), codes, counts)

    counts = checkpointed(sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    tops = [counts.where(F.col("lang") == lang).orderBy(F.desc("n"), "code").limit(size) for lang in sorted(per)]
    found: dict[str, list] = {lang: [] for lang in per}
    for top in tops:  # a distributed top-k for each language
        for r in top.collect():
            found[r["lang"]].append((-r["n"], r["code"]))
    return Profiles({lang: np.array([c for _, c in sorted(x)], np.int64) for lang, x in found.items() if x}, size)


def _add(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row's whole text; no letter or null text: und, 0."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # at most `size` codes a language

    def run(batches):
        own = shared.value
        for batch in pieces(batches):
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield as_batch(_PREDICTED, batch.column(0), [x for x, _ in found], [s for _, s in found])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, profiles: Profiles, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """``docs`` with the two columns added (or replaced), in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    docs = docs.drop(pred_col, score_col)
    place = docs.columns.index(text_col)

    def run(batches):
        own = shared.value
        for batch in pieces(batches):
            found = [own.predict(t) for t in batch.column(place).to_pylist()]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, pred_col, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())]))
