"""Compression classifier: zstandard dictionaries of good and of bad text, their size difference calibrated to a score.

A text is compressed with the dictionary built from good labelled text, with that built from bad, and with none.
The normalised difference of the first two says which kind of text it resembles; the last, a share of its
own length, tells how repetitive it is. A logistic curve fitted on labelled texts that went into no dictionary
turns these sizes into the probability of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample, for each label: half for the dictionary, half for the calibration.
SAMPLE_PER_LABEL = 3000
DICT_BYTES, LEVEL = 65536, 3
FOLDS, HELD_OUT_FOLD, THRESHOLD = 5, 0, 0.3


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [t[i : i + 512] for t in texts for i in range(0, len(t), 512)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(texts)[-DICT_BYTES:]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (_inputs(self.good, self.bad, texts) - np.array(self.mean)) / np.array(self.scale)
        return _curve(np.column_stack([x, np.ones(len(x))]) @ np.array(self.weights)) if len(x) else np.zeros(0)


def _curve(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) if d else zstandard.ZstdCompressor(**plain) for d in (good, bad, b"")]


def _inputs(good: bytes, bad: bytes, texts: list[str | None]) -> np.ndarray:
    tools, out = _compressors(good, bad), np.empty((len(texts), 6))
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        g, b, p = (len(c.compress(raw)) for c in tools)
        d, own, size = (b - g) / (b + g), min(1.5, p / (len(raw) + 20)), np.log(len(raw) + 20)
        out[i] = np.clip(d, -0.3, 0.3), own, own * own, size, np.clip(d, -0.3, 0.3) * size, own * size
    return out


def fit(good: list[str], bad: list[str], share_good: float) -> Model:
    """From labelled texts; share_good is the share of label 1 among all labelled rows that may be learnt from."""
    kinds = [[t.encode("utf-8", "surrogatepass") for t in x[: (len(x) + 1) // 2]] for x in (good, bad)]
    rest = [x[(len(x) + 1) // 2 :] for x in (good, bad)]
    if not all(map(len, rest)):
        flat = float(np.log((share_good + 1e-3) / (1 - share_good + 1e-3)))
        return Model(b"", b"", (0.0,) * 6, (1.0,) * 6, (0.0,) * 6 + (flat,))
    dicts = [_dictionary(k) for k in kinds]
    x = _inputs(*dicts, rest[0] + rest[1])
    y = np.append(np.ones(len(rest[0])), np.zeros(len(rest[1])))
    w = np.where(y == 1, share_good / len(rest[0]), (1 - share_good) / len(rest[1])) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = _curve(z @ beta)
        h = (z * (w * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(beta))
        beta += np.linalg.solve(h, z.T @ (w * (y - p)) - 0.05 * beta)
    return Model(*dicts, tuple(mean), tuple(scale), tuple(beta))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from at most SAMPLE_PER_LABEL documents a label, none of the held-out fold, picked by a hash of the id.

    Rows of labels that repeat count once; a doc_id with both labels is learnt as both. Of rows that share a doc_id the
    smallest text is taken. Null ids, labels and texts are not learnt from.
    """
    usable = labels.select("doc_id", "quality").filter((fold() != HELD_OUT_FOLD) & F.col("quality").isin(0, 1)).distinct()
    n = dict(usable.groupBy("quality").count().collect())
    picked = None
    for label in (0, 1):
        some = usable.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(SAMPLE_PER_LABEL)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.filter(F.col("text").isNotNull()).select("quality", "text", F.xxhash64("doc_id", F.lit(7)).alias("h"), "doc_id").collect()  # at most 2 * SAMPLE_PER_LABEL
    by = {k: [r.text for r in sorted((r for r in rows if r.quality == k), key=lambda r: (r.h, r.doc_id))] for k in (0, 1)}
    return fit(by[1], by[0], n.get(1, 0) / max(1, sum(n.values())) if n else 0.5)


def add_scores(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs plus out_col in [0, 1]; only the text is looked at. Null text is empty. A column named out_col is replaced."""
    names = docs.columns
    at, keep = names.index(text_col), [k for k, c in enumerate(names) if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s, pa.float64())], [*(names[k] for k in keep), out_col])

    return docs.mapInArrow(run, docs.select(*[F.col(f"`{names[k]}`") for k in keep], F.lit(0.0).alias(out_col)).schema)


def score_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs, whose other columns are left out. Without labels all scores are alike."""
    out = add_scores(docs.select("doc_id", "text"), learn(docs, labels))
    held = F.coalesce(fold() == HELD_OUT_FOLD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
