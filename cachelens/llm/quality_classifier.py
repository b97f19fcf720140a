"""Quality classifier from weak labels.

Overlapping heuristics each vote good (1), bad (-1) or abstain (0). Votes are counted by pattern over all documents,
and expectation-maximisation on the counts estimates how often each heuristic votes what in good and in bad documents.
The resulting posteriors label a bounded sample, on which a hashed linear scorer is trained; its score decides.

Null, empty and word-less texts get abstentions only, so the classes' shares decide about them; with nothing else to
learn from they are kept. An empty table gives an empty result. Repeated rows vote again, other columns pass unread. Texts
are measured whole, however long; a text's copies get its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .quality_rules import text_stats

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = """the of and to in is that it for on with as was be by this are or from at an a he
der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an
le la les de des et un une du en dans que qui pour sur par au est pas plus
el los las del y por con no se su al lo como más pero sus una"""
_STOP = frozenset(w.encode() for w in STOP_WORDS.split())
#: name: (value at most for a good vote, value at least for a bad vote) over the measures of ``measures``.
LABELLERS = {
    "symbols": (0.02, 0.10),
    "repeats": (0.15, 0.40),
    "capitals": (0.20, 0.45),
    "shouting": (0.03, 0.15),
    "one_word": (0.15, 0.30),
    "same_lines": (0.20, 0.50),
    "long_words": (6.2, 6.6),
    "few_stop_words": (0.93, 0.985),
    "narrow_vocabulary": (0.60, 0.80),
}
BITS, SEED = 11, 0x9E3779B97F4A7C15
#: Steps in which a share of all documents is drawn.
DRAWN = 1 << 40
#: Letters to "a" or "A", digits to "0"; white space and punctuation stay: a text's shape.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))


def measures(text: str | None) -> list[float] | None:
    """The labellers' values for a text, or None where it has no words."""
    n, chars, symbols, _, repeats = text_stats(text)
    if not n:
        return None
    raw = text.encode()
    words = raw.lower().split()
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [line for line in raw.split(b"\n") if line.strip()]
    upper = sum(map(raw.count, _CAPITALS))
    stop = sum(map(_STOP.__contains__, (w.strip(b".,;:!?") for w in words)))
    return [
        symbols / n, repeats / n, upper / chars, raw.count(b"!") / n, max(count.values()) / n if n >= 20 else 0.0,
        1 - len(set(lines)) / len(lines) if len(lines) >= 4 else 0.0, chars / n, 1 - stop / n if n >= 20 else 0.95,
        1 - len(count) / n if n >= 50 and n <= 2000 else 0.7,
    ]


_CAPITALS = [bytes([b]) for b in range(65, 91)]


def votes(values: list[float] | None) -> str:
    """One character per labeller: + good, - bad, 0 abstains."""
    if values is None:
        return "0" * len(LABELLERS)
    return "".join("+" if v <= good else "-" if v >= bad else "0" for v, (good, bad) in zip(values, LABELLERS.values()))


def fit_labellers(counts: dict[str, int], rounds: int = 100) -> dict:
    """Expectation-maximisation on vote patterns: class share, and P(vote | class, not abstaining) of each labeller.

    An abstention says nothing about the class. Starts from the majority of votes, so class 1 is the one that heuristics call good.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([["-0+".index(c) for c in p] for p in patterns], int).reshape(len(patterns), len(LABELLERS))
    post = np.clip((vote - 1).sum(1) / len(LABELLERS) * 0.5 + 0.5, 0.02, 0.98)
    share, rates = 0.5, np.full((2, len(LABELLERS), 3), 1 / 3)
    for _ in range(rounds if len(patterns) else 0):
        for y, weight in ((0, n * (1 - post)), (1, n * post)):
            for j in range(len(LABELLERS)):
                seen = np.bincount(vote[:, j], weight, 3) + 0.1
                rates[y, j] = seen / (seen[0] + seen[2])
                rates[y, j, 1] = 1.0
        share = (n @ post + 1) / (n.sum() + 2)
        new = posterior(vote, share, rates)
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
    return {"share": share, "rates": rates}


def posterior(vote: np.ndarray, share: float, rates: np.ndarray) -> np.ndarray:
    """P(good | votes), votes as 0 bad, 1 abstain, 2 good."""
    j = np.arange(vote.shape[1])
    log = [np.log(rates[y, j, vote]).sum(1) for y in (0, 1)]
    return 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - share) - log[1] - np.log(share), -500, 500)))


def posterior_of(model: dict, patterns: list[str]) -> np.ndarray:
    vote = np.array([["-0+".index(c) for c in p] for p in patterns], int).reshape(len(patterns), len(LABELLERS))
    return posterior(vote, model["share"], model["rates"])


def features(text: str | None, values: list[float] | None) -> np.ndarray:
    """Hashed shape trigrams of the whole text (square roots of shares, length 1) and hashed steps of the measures."""
    out = np.zeros(1 << BITS, np.float32)
    if values is None:
        return out
    a = np.frombuffer(text.encode().translate(SHAPE), np.uint8).astype(np.uint64)
    if len(a) >= 3:
        code = (a[:-2] * np.uint64(65536) + a[1:-1] * np.uint64(256) + a[2:]) * np.uint64(SEED)
        out += np.sqrt(np.bincount((code >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS) / (len(a) - 2)).astype(np.float32)
    for j, (v, (good, bad)) in enumerate(zip(values, LABELLERS.values())):
        step = int(np.clip(np.floor(4 * (v - good) / (bad - good)), -1, 4)) + 1
        out[((j * 8 + step + 1) * SEED % (1 << 64)) >> (64 - BITS)] += 0.5
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = 200, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full-batch Adam."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m = v = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(1, steps + 1 if len(y) else 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -30, 30)))
        error = (p - y).astype(np.float32)
        g = np.append(error @ x / len(y) + l2 * w, error.mean()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = (0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(measures(t)) for t in batch.column("text").to_pylist()], pa.string())], ["votes"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        values = [measures(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), pa.array(map(votes, values), pa.string()), pa.array([features(t, v).astype(np.float16).tobytes() for t, v in zip(texts, values)], pa.binary())],
            ["place", "votes", "x"],
        )


def _score(model: dict, w: np.ndarray, b: float, names: list[str], text_at: str):
    w = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            values = [measures(t) for t in texts]
            patterns = [votes(v) for v in values]
            scores = [float(1 / (1 + np.exp(-np.clip(features(t, v) @ w + b, -30, 30)))) for t, v in zip(texts, values)]
            kept = [v is None or s >= 0.5 for v, s in zip(values, scores)]
            added = [pa.array(patterns, pa.string()), pa.array(posterior_of(model, patterns), pa.float64()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *added], [*names, *ADDED])

    return run


ADDED = ["cl_votes", "cl_posterior", "cl_score", "cl_kept"]


def _keep(model: dict, w: np.ndarray, b: float, text_at: str):
    w = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [(t, measures(t)) for t in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array([v is None or float(features(t, v) @ w + b) >= 0 for t, v in values], pa.bool_()))

    return run


def keep(docs: DataFrame, sample_rows: int = 4000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns as they are."""
    return docs.mapInArrow(released(_keep(*fit(docs, sample_rows, text_col), text_col)), docs.schema)


def fit(docs: DataFrame, sample_rows: int = 4000, text_col: str = "text") -> tuple[dict, np.ndarray, float]:
    """The labellers' model and the scorer's weights.

    Patterns are counted over all documents (at most 3 ** labellers rows reach the driver). The scorer is trained on at
    most ``sample_rows`` distinct texts, 4 KB each on the driver: of those that a hash of the text draws, about twice as many
    as needed, the ones with the least hashes, so neither copies nor the order of rows matter.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = {r.votes: r.n for r in texts.mapInArrow(released(_votes), "votes string").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit_labellers(counts)
    total = max(1, sum(counts.values()))
    place = F.xxhash64("text", F.lit(7))
    drawn = texts.withColumn("place", place).where(F.pmod("place", F.lit(DRAWN)) < int(min(1.0, 2 * sample_rows / total) * DRAWN))
    made = drawn.mapInArrow(released(_sample), "place long, votes string, x binary").dropDuplicates(["place"])
    sample = made.orderBy(F.pmod("place", F.lit(DRAWN)), "place").limit(sample_rows).collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in sample], np.float32).reshape(len(sample), 1 << BITS)
    return model, *fit_scorer(x, posterior_of(model, [r.votes for r in sample]))


def classify(docs: DataFrame, sample_rows: int = 4000, text_col: str = "text") -> DataFrame:
    """``docs`` with cl_votes, cl_posterior, cl_score and cl_kept, in place of own columns of these names."""
    model, w, b = fit(docs, sample_rows, text_col)
    names = [c for c in docs.columns if c not in ADDED]
    kept = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", cl_votes string, cl_posterior double, cl_score double, cl_kept boolean"
    return kept.mapInArrow(released(_score(model, w, b, names, text_col)), schema)
