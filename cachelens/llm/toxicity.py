"""Toxicity classifier with counterfactual regularisation.

A text is the set of its hashed byte n-grams inside and across word borders (lower-cased, punctuation as space), which
catches inflected forms of a stem. Features are screened by their counts in toxic and other labelled texts, then a
logistic model is fitted. In labelled sentences that name a group, the identity terms are swapped for others of their
kind; the fit adds ``pairing`` times the squared change of the logit, so that naming a group does not move a score.

Null, empty and short texts have no features and get the intercept's score. Rows without a label are only scored. A
document labelled twice counts as toxic if any label says so. Without labelled rows every score is 0. Repeated rows are
learnt from and scored each; ties among features go by their number. Texts are read whole, however long. Other columns
aren't read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .decontam import WORDS

#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = {
    "gender": "women men girls boys",
    "gender_one": "woman man girl boy",
    "religion": "muslim christian jewish hindu buddhist atheist",
    "religions": "muslims christians jews hindus buddhists atheists",
    "origin": "african asian european american mexican arab",
    "origins": "africans asians europeans americans mexicans arabs",
    "colour": "black white brown",
    "orientation": "gay straight lesbian bisexual",
    "age": "elderly young old",
    "ability": "disabled deaf blind autistic",
}
SWAP = {t.encode(): ts[(k + 1) % len(ts)].encode() for line in IDENTITY_TERMS.values() for ts in [line.split()] for k, t in enumerate(ts)}
_TERM = re.compile(rb"(?<![a-z0-9\x80-\xff])(" + b"|".join(sorted(SWAP, key=len, reverse=True)) + rb")(?![a-z0-9\x80-\xff])")

BITS, SIZES, SEED = 20, (5, 7), 0x9E3779B97F4A7C15


def normalised(text: str | None) -> bytes:
    return b" " + b" ".join(text.encode().translate(WORDS).split()) + b" " if text else b""


def swapped(raw: bytes) -> bytes | None:
    """The text with each identity term swapped, or None where it names none."""
    new = _TERM.sub(lambda m: SWAP[m[1]], raw)
    return None if new == raw else new


def grams(raw: bytes) -> np.ndarray:
    """Hashes of all n-grams of a normalised text, with repetitions."""
    a, out = np.frombuffer(raw, np.uint8).astype(np.uint64), []
    for n in SIZES:
        if len(a) >= n:
            code = a[: len(a) - n + 1].copy()
            for k in range(1, n):
                code *= np.uint64(257)
                code += a[k : len(a) - n + 1 + k]
            code *= np.uint64(SEED + 2 * n)
            out.append((code >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature and label, one row per feature and task."""
    seen = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen[toxic, np.unique(grams(normalised(text)))] += 1
    f = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(seen[0, f], pa.int64()), pa.array(seen[1, f], pa.int64())], ["feature", "clean", "toxic"])


def _training(slots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for text in batch.column("text").to_pylist():
                raw = normalised(text)
                other = swapped(raw)
                xs.append(_slots(raw, slots))
                ys.append(None if other is None else _slots(other, slots))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(xs, kind), pa.array(ys, kind)], ["toxic", "x", "swapped"])

    return run


def _slots(raw: bytes, slots: np.ndarray) -> np.ndarray:
    s = slots[grams(raw)]
    return np.unique(s[s >= 0]).astype(np.int32)


def fit(rows: list, n_features: int, pairing: float = 1.0, l1: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Proximal gradient (Adam steps) on log loss + pairing * mean squared logit change under swaps + l1."""
    w, b = np.zeros(n_features), 0.0
    if not rows:
        return w, -np.inf
    y = np.array([r.toxic for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r.x) for r in rows])
    x = np.array([s for r in rows for s in r.x], np.int64)
    pairs = [r for r in rows if r.swapped is not None]
    row = np.repeat(np.arange(len(pairs)), [len(r.x) + len(r.swapped) for r in pairs])
    col = np.array([s for r in pairs for s in (*r.x, *r.swapped)], np.int64)
    sign = np.array([v for r in pairs for v in [1.0] * len(r.x) + [-1.0] * len(r.swapped)])
    m = v = np.zeros(n_features + 1)
    b = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for t in range(1, steps + 1):
        z = np.bincount(at, w[x], len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(x, (p - y)[at], n_features) / len(rows)
        if pairs:
            change = np.bincount(row, sign * w[col], len(pairs))
            g += pairing * 2 * np.bincount(col, sign * change[row], n_features) / len(pairs)
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 / (np.sqrt(v / (1 - 0.999**t)) + 1e-3)
        step = rate * m / (1 - 0.9**t)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * rate[:-1] * 0.1, 0)
    return w, float(b)


def _scores(slots: np.ndarray, w: np.ndarray, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([w[_slots(normalised(t), slots)].sum() + b for t in batch.column("text").to_pylist()], float)
            score = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, sample_rows: int = 20_000, n_features: int = 4096, pairing: float = 1.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (crc32 of the id modulo ``folds`` is ``held_fold``), score, predicted.

    The model is fitted on about ``sample_rows`` labelled rows outside the held-out fold, drawn by a hash of the id;
    their ids and labels are the only broadcast, and the screened features (4 bytes each) the only data collected.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    known = labels.where((fold != held_fold) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    share = min(1.0, sample_rows / max(1, labels.count()))
    known = known.where(F.pmod(F.xxhash64("of", F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"))
    train = rows.join(F.broadcast(known), F.col("doc_id") == F.col("of")).select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counted = train.mapInArrow(released(_screen), "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    expected = (F.col("toxic") + F.col("clean")) * rate
    gain = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    chosen = [r.feature for r in counted.where(F.col("toxic") >= 3).where(gain > 0).orderBy(gain.desc(), "feature").limit(n_features).collect()]
    slots = np.full(1 << BITS, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    data = train.mapInArrow(released(_training(slots)), "toxic int, x array<int>, swapped array<int>").collect()
    w, b = fit(data, max(1, len(chosen)), pairing)
    used = np.flatnonzero(w[: len(chosen)])
    small = np.full(1 << BITS, -1, np.int32)
    small[np.array(chosen, int)[used]] = np.arange(len(used))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(released(_scores(small, np.append(w[used], 0.0), b)), schema).withColumnRenamed("doc_id", id_col)
