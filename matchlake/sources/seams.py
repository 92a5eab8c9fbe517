"""Seams for models that are not part of the engine: encoders, recognisers, detectors.

A model is a function of a batch of image bytes, made by a loader that runs once in each
Python worker. The stand-ins are deterministic, so plans can be run and tested without
a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR = "array<double>"
LINES = "array<struct<text:string,score:double,box:array<array<double>>>>"
BOXES = "array<struct<label:string,score:double,box:array<double>>>"


def apply_model(images: DataFrame, loader: Callable[[], Callable[[list[bytes]], list]], column: str, kind: str, batch: int = 16) -> DataFrame:
    """``images`` (with content) with the model's answer in ``column``; a failed image gives null, not a failed job."""
    names = images.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or loader()
            out: list = []
            for at in range(0, len(frame), batch):
                part = [bytes(c) for c in frame["content"].iloc[at : at + batch]]
                try:
                    out += list(model(part))
                except ValueError:
                    for one in part:
                        try:
                            out += list(model([one]))
                        except ValueError:
                            out.append(None)
            yield frame[names].assign(**{column: pd.Series(out, index=frame.index, dtype=object)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    return images.mapInPandas(run, f"{fields}, `{column}` {kind}")


def hash_encoder(dim: int = 64) -> Callable[[list[bytes]], list]:
    """Stand-in encoder: a unit vector that the bytes decide."""

    def encode(contents: list[bytes]) -> list:
        out = []
        for c in contents:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(c).digest()[:8])).standard_normal(dim)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return encode


def line_reader() -> Callable[[list[bytes]], list]:
    """Stand-in recogniser: the bytes as lines of text, one under the other."""

    def read(contents: list[bytes]) -> list:
        out = []
        for c in contents:
            lines = c.decode("utf-8", "replace").splitlines()
            out.append([{"text": t, "score": 0.9, "box": [[0.0, 20.0 * i], [100.0, 20.0 * i], [100.0, 20.0 * i + 15], [0.0, 20.0 * i + 15]]} for i, t in enumerate(lines)])
        return out

    return read


def usable_lines(rows: DataFrame, column: str = "lines", score: float = 0.45, least: int = 3) -> DataFrame:
    """Only lines that were read with some confidence and have a few letters or digits."""
    return rows.withColumn(column, F.filter(column, lambda x: (x["score"] >= score) & (F.length(F.regexp_replace(x["text"], r"[^\p{L}\p{N}]", "")) >= least)))


def first_text(primary: str, fallback: str):
    """The first recogniser's text, else the second's."""
    return F.coalesce(F.nullif(F.trim(F.col(primary)), F.lit("")), F.col(fallback))


def index_new(images: DataFrame, have: DataFrame, loader, model: str, kind: str = VECTOR, force: bool = False) -> DataFrame:
    """(entity, model, digest, vector) of images that the index does not hold yet."""
    keyed = images.withColumn("model", F.lit(model))
    todo = keyed if force else keyed.join(have.select("entity", "model", "digest").distinct(), ["entity", "model", "digest"], "left_anti")
    return apply_model(todo.select("entity", "model", "digest", "content"), loader, "vector", kind).drop("content")
