"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight per hashed word, word beginning and shape of text, shared by all grades, gives a text a single score s; ordered
thresholds cut it: P(grade <= k) = sigmoid(threshold_k - s). Expected grade and the tail
probability P(grade >= k) follow from that.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import document_chunks, texts
from tabulant.llm.samples import bottom_sample

WORD = re.compile(r"[^\W\d_]+")
CACHED = 300_000


def shape_features(text: str, words: list[str], kinds: int) -> list[str]:
    """Names of features of the form of a text: length, repetition, letters, upper case."""
    n = len(text)
    step = lambda x: str(int(10 * x))
    letters = sum(map(len, words))
    return [
        "\x00length" + str(n.bit_length()),
        "\x00distinct" + step(kinds / len(words) if words else 0),
        "\x00letters" + step(letters / n if n else 0),
        "\x00upper" + step(len(re.findall("[A-Z]", text)) / n if n else 0),
        "\x00bars" + step(min(1.0, 8 * text.count("|") / n) if n else 0),
        "\x00marks" + step(min(1.0, 4 * len(re.findall(r"[#$%&*!=<>{}]", text)) / n) if n else 0),
        "\x00bias",
    ]


def stems(kinds: set[str]) -> set[str]:
    """First letters of the words, marked so that they are not words themselves."""
    return {"\x01" + w[:4] for w in kinds}


def feature(name: str, bits: int) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & ((1 << bits) - 1)


def features_of(text: str, bits: int) -> np.ndarray:
    words = WORD.findall(text.lower())
    kinds = set(words)
    names = [*kinds, *stems(kinds), *shape_features(text, words, len(kinds))]
    return np.unique(np.array([feature(x, bits) for x in names], np.int64))


def fit(
    rows: list[tuple[int, np.ndarray]], grades: int, bits: int, passes: int, penalty: float = 10.0
) -> dict:
    """Weights and thresholds that maximise the penalised likelihood of (grade, features)."""
    y = np.array([g for g, _ in rows])
    # what few texts have tells nothing about grades
    seen = np.bincount(np.concatenate([f for _, f in rows]), minlength=1 << bits)
    often = seen >= min(10, len(rows))
    rows = [(g, f[often[f]]) for g, f in rows]
    flat = np.concatenate([f for _, f in rows])
    size = np.array([len(f) for _, f in rows])
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(rows)), size)
    w = np.zeros(1 << bits)
    share = np.bincount(y, minlength=grades) + 0.5
    below = np.cumsum(share)[:-1] / share.sum()
    cut = np.log(below / (1 - below))
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    params = [w, free]
    slow = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    n = len(rows)
    weight = (n / (np.bincount(y, minlength=grades) + 1.0))[y] ** 0.5  # rare grades count more
    for step in range(1, passes + 1):
        cut = np.cumsum(np.concatenate([params[1][:1], np.exp(params[1][1:])]))
        s = np.add.reduceat(params[0][flat], starts)
        edge = np.concatenate([[-np.inf], cut, [np.inf]])
        hi, lo = sigmoid(edge[y + 1] - s), sigmoid(edge[y] - s)
        hi[y == grades - 1], lo[y == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        ds = (dlo - dhi) * weight
        dcut = np.bincount(y, dhi * weight, grades)[:-1] - np.bincount(y, dlo * weight, grades)[1:]
        dfree = np.cumsum(dcut[::-1])[::-1]
        dfree[1:] *= np.exp(params[1][1:])
        gw = np.bincount(flat, ds[owner], 1 << bits) - penalty * params[0]
        for q, g, (m, v) in zip(params, [gw / n, dfree / n], slow):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    cut = np.cumsum(np.concatenate([params[1][:1], np.exp(params[1][1:])]))
    return {"weights": params[0].astype(np.float32), "cuts": cut, "bits": bits, "grades": grades}


def _featurizer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features_of(t, bits).tolist() for t in b.column("text").to_pylist()]
            yield pa.record_batch(
                [b.column("grade"), pa.array(got, pa.list_(pa.int32()))], names=["grade", "f"]
            )

    return run


def train(
    docs: DataFrame,
    ratings: DataFrame,
    grade: Column,
    grades: int,
    key: str = "doc_id",
    text: str = "text",
    sample: int = 6000,
    bits: int = 18,
    passes: int = 80,
) -> dict:
    """Fit on at most `sample` rated documents (those with the smallest hashed ids).

    `grade` is an expression over `ratings` with values 0 to grades - 1; rows where it is
    null or out of range, or whose document is missing, are not used. The sample's ids go
    to the join as a broadcast of bounded size and only hashed features come back. With
    no usable row the classifier knows nothing: all grades are equally likely.
    """
    rated = ratings.select(
        F.col(f"`{key}`").cast("long").alias("id"), grade.cast("int").alias("grade")
    ).where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1))
    picked = [tuple(r) for r in bottom_sample(rated, F.xxhash64("id"), sample).collect()]
    even = np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))
    empty = {"weights": np.zeros(1 << bits, np.float32), "cuts": even, "bits": bits, "grades": grades}
    if not picked:
        return empty
    small = docs.sparkSession.createDataFrame(picked, "id long, grade int")
    rows = texts(docs, key, text).join(F.broadcast(small), "id").select("grade", "text")
    got = bottom_sample(rows, F.xxhash64("text"), 2 * sample)
    got = got.mapInArrow(_featurizer(bits), "grade int, f array<int>").collect()
    data = sorted((r.grade, tuple(r.f)) for r in got)
    if not data:
        return empty
    return fit([(g, np.array(f, np.int64)) for g, f in data], grades, bits, passes)


def _grader(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[str, float] = model.setdefault("known", {})
        w, bits, cuts = model["weights"], model["bits"], model["cuts"]
        for ids, bodies in document_chunks(batches):
            tails = []
            for body in bodies:
                text = body.decode()
                words = WORD.findall(text.lower())
                kinds = set(words)
                names = kinds.union(stems(kinds), shape_features(text, words, len(kinds)))
                new = names.difference(known)
                if len(known) + len(new) > CACHED:
                    known.clear()
                    new = names
                for x in new:
                    known[x] = float(w[feature(x, bits)])
                s = math.fsum(map(known.__getitem__, names))
                tails.append([1 / (1 + math.exp(min(40.0, max(-40.0, c - s)))) for c in cuts])
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([sum(t) for t in tails], pa.float64()),
                    pa.array(tails, pa.list_(pa.float64())),
                ],
                names=["doc_id", "expected_grade", "tails"],
            )

    return run


def grade_texts(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade and tails: P(grade >= 1), P(grade >= 2), ... of each whole text.

    The weights (2**bits numbers) go to the workers; there is no shuffle. A null text is
    graded as an empty one; repeated rows give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return texts(docs, key, text).mapInArrow(
        _grader(shared), "doc_id long, expected_grade double, tails array<double>"
    )
