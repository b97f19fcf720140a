"""Quality rules: text statistics, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, runs of white space to one space) and hashed to 64 bits; lines without a word
are ignored. For each host the distinct documents of a line are counted. A line on more documents than the host's
limit, ``max(min_docs, share * documents of the host)``, is boilerplate and counts as removed. A document is depleted,
and rejected, when fewer than ``min_words`` words or less than ``min_left`` of its words remain.

Null and empty texts have no words and fail the base rules. A null host is a host of its own. Every row is a document:
repeated rows and ids are judged each for itself, and equal rows count as several documents of their host. Texts are
measured whole, however long. Other columns aren't read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written

#: Symbols of the base rules, and the six characters that separate words.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Boilerplate lines that are broadcast at most; beyond it the lines are joined by a shuffle. 16 bytes each.
BROADCAST_LINES = 500_000

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    code = ids[:-2] * v + ids[1:-1]
    if v < 2_000_000:
        code = code * v + ids[2:]
    else:  # v**3 would overflow: number the pairs first
        code = np.unique(code, return_inverse=True)[1].astype(np.int64) * v + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)] if "\n" in text else []
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def line_words(text: str | None) -> dict[int, int]:
    """Hash of each normalised line to the words under it, all repetitions together."""
    out: dict[int, int] = {}
    for line in text.encode().lower().split(b"\n") if text else ():
        words = line.split()
        if words:
            key = xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)
            out[key] = out.get(key, 0) + len(words)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        stats = list(zip(*map(text_stats, texts))) or [[]] * 5
        lines = [line_words(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("host"), *(pa.array(s, pa.int64()) for s in stats),
                pa.array([list(x) for x in lines], pa.list_(pa.int64())), pa.array([list(x.values()) for x in lines], pa.list_(pa.int32())),
            ],
            ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line", "words"],
        )


def quality_rules(docs: DataFrame, min_docs: int = 20, share: float = 0.01, min_words: int = 50, min_left: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: the id, the base statistics, base_failed, removed_words, n_removed_lines, kept.

    Texts are read once and never shuffled; lines travel as (line hash salted with the host, words). The count per
    line is summed on the map side first, so a line in a third of all documents costs a row per task.
    """
    measured = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
        .mapInArrow(released(_measure), f"doc_id {docs.schema[id_col].dataType.simpleString()}, host string, {STATS}, line array<long>, words array<int>")
        .withColumn("row", F.monotonically_increasing_id()),
        "lines",
    )
    host_docs = measured.groupBy("host").agg(F.greatest(F.lit(min_docs), F.count(F.lit(1)) * share).alias("limit"))
    lines = measured.select("row", "host", F.explode(F.arrays_zip("line", "words")).alias("x"))
    lines = lines.select("row", "host", F.xxhash64("host", "x.line").alias("key"), F.col("x.words").alias("words"))
    common = (
        lines.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.first("host").alias("host")).where(F.col("docs") > min_docs)
        .join(host_docs.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where("docs > limit").select("key")
    )
    common = written(common, "common-lines")
    if common.count() <= BROADCAST_LINES:
        common = F.broadcast(common)
    removed = lines.join(common, "key", "left_semi").groupBy("row").agg(F.sum("words").alias("removed_words"), F.count(F.lit(1)).alias("n_removed_lines"))
    out = measured.drop("line", "words").join(removed, "row", "left").na.fill(0, ["removed_words", "n_removed_lines"])
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= min_left * F.col("n_words"))).alias("kept"), "removed_words", "n_removed_lines",
    )
