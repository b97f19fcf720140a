"""Near-duplicates with SetSketch registers.

A document's set is its distinct 5-word shingles. A sketch holds ROWS registers a band, maxima of ``floor(1 - log_b x)``, x being
exponentially distributed for each (shingle, register): minima on an exponential scale, cut to 16 bits, which merge by
maximum and agree in a register with about the probability of the Jaccard similarity. Documents of equal sets are one
class. Classes that agree in all registers of a band are candidates; candidates that are chained by bands form a
group. Inside a group the joint likelihood of two sketches, given the set sizes, tells whether the similarity may reach
the threshold, and only then are the full sets compared. Links of confirmed pairs give the components.

A group is worked on where all its classes lie, in blocks of BLOCK classes; long texts count as several. Larger groups are dealt over blocks, each
with the same few centres, and what is not joined to the group's largest component by then is compared with every
block of the group, whole. Pairs never leave a task; only links between different components do.

The number of bands follows the threshold, so that a pair just at it shares no band with probability 1e-6 at most: 24
bands of 5 at 0.85 (8e-7), 35 at 0.80 (9e-7). The cut lies 0.15 under the threshold; such a pair's estimate falls under
it with about 2e-6. Sets are never sampled and nothing is capped.

Null, empty and word-less texts have empty sets and are linked with nothing. With fewer than five words the whole
sequence is one shingle. Texts are taken whole, however long. Other columns aren't read, whatever their names, and pass
``deduplicate`` unchanged. An empty table gives an empty result. Rows of equal id are separate documents; a null id never names a component unless no other
member has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, released, remembered, written
from .components import components

WIDTH = 5
#: Bands at the least, and the registers they have.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Base and rate of the sketch. With b near 1, registers tell as much as plain minima.
BASE, RATE = 1.001, 20.0
#: Classes of a block, and the shingles for which a class counts as one more.
BLOCK, LONG = 2000, 4000
#: Ids of candidates that are broadcast at most (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: int) -> int:
    """Bands by which all but a millionth of the pairs at ``threshold`` become candidates."""
    none = 1 - (threshold / 100) ** ROWS  # a band is not shared
    return max(BANDS, int(np.ceil(np.log(1e-6) / np.log(none)))) if none > 0 else BANDS


def cut_for(threshold: int) -> float:
    return threshold / 100 - 0.15


@cache
def _hashing(registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands; those of fewer registers come first."""
    random, drawn = np.random.default_rng(20_240_701), []
    for _ in range(0, registers, REGISTERS):
        multiply = random.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
        drawn.append((multiply, random.integers(0, 1 << 63, REGISTERS, np.uint64)))
    multiply, add = map(np.concatenate, zip(*drawn))
    return multiply[:registers], add[:registers]


class _Hashes(dict):
    """Word hashes, remembered in the worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(remembered("word hashes", _Hashes).__getitem__, words), np.uint64, n)
    k = min(width, n)
    code = h[: n - k + 1].copy()
    for j in range(1, k):
        code *= _P
        code += h[j : n - k + 1 + j]
    code += np.uint64(k)
    code ^= code >> np.uint64(31)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(29)
    return np.unique(code)


def sketch(s: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """``registers`` maxima for a set of hashes."""
    multiply, add = _hashing(registers)
    least = np.full(registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(s), 2048):
        np.minimum(least, (s[at : at + 2048, None] * multiply + add).min(0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype(np.uint16)


def may_reach(equal: np.ndarray, more: np.ndarray, n: float, ns: np.ndarray, cut: float, registers: int = REGISTERS) -> np.ndarray:
    """Whether the likeliest similarity is at least ``cut``, from how many registers of one sketch equal and exceed
    those of others, and the set sizes. The likelihood has one maximum, so its slope at ``cut`` decides."""
    u = n / (n + ns)
    v = 1 - u
    possible = np.minimum(u, v) >= cut * np.maximum(u, v)
    j = np.minimum(cut, np.minimum(u / v, v / u) * 0.999)
    c = (BASE - 1) / BASE
    f = lambda y: -np.log1p(-y * c) / np.log(BASE)  # noqa: E731  P(a register exceeds), and its slope
    g = lambda y: c / (1 - y * c) / np.log(BASE)
    a, b = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    same = np.maximum(1 - f(a) - f(b), 1e-12)
    slope = -more * v * g(a) / f(a) - (registers - equal - more) * u * g(b) / f(b) + equal * (v * g(a) + u * g(b)) / same
    return possible & (slope >= 0)


def _classes(registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketch(s, registers).astype("<u2").tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "mark", "n_shingles", "cls", "registers"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["cls", "shingles"])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Values that two sorted sets have in common."""
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def _link(threshold: int, cut: float):
    """Links between different components of each run of equal keys; rows come sorted by key."""

    def block(rows: list[dict]) -> list[tuple[bytes, bytes]]:
        rows = list({r["cls"]: r for r in sorted(rows, key=lambda r: r["query"])}.values())
        n = len(rows)
        if n < 2:
            return []
        root = {}

        def find(x: bytes) -> bytes:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        mine = [r["component"] for r in rows]
        reg = np.array([np.frombuffer(r["registers"], "<u2") for r in rows])
        sizes = np.array([len(r["shingles"]) // 8 for r in rows], float)

        def whole(k: int) -> np.ndarray:
            return np.frombuffer(rows[k]["shingles"], np.uint64)

        links = []
        asked = np.array([r["query"] for r in rows])
        for i in np.flatnonzero(asked).tolist():
            others = np.concatenate((np.flatnonzero(~asked[:i]), np.arange(i + 1, n)))
            if not len(others):
                continue
            equal = (reg[others] == reg[i]).sum(1)
            near = may_reach(equal, (reg[others] < reg[i]).sum(1), sizes[i], sizes[others], cut, reg.shape[1])
            for k in sorted(np.flatnonzero(near).tolist(), key=lambda k: -equal[k]):
                j = int(others[k])
                if find(mine[i]) == find(mine[j]):
                    continue
                both = _shared(whole(i), whole(j))
                if 100 * both >= threshold * (sizes[i] + sizes[j] - both):
                    root[find(mine[i])] = find(mine[j])
                    links.append((rows[i]["cls"], rows[j]["cls"]))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            links = block(rows)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                now = (r["grp"], r["block"], r["part"])
                if now != key:
                    yield from out()
                    key, rows = now, []
                rows.append(r)
        yield from out()

    return run


def _linked(rows: DataFrame, threshold: int, cut: float) -> DataFrame:
    keys = ["grp", "block", "part"]
    rows = rows.select(*keys, "cls", "component", "query", "registers", "shingles")
    return rows.repartition(*map(F.col, keys)).sortWithinPartitions(*keys).mapInArrow(released(_link(threshold, cut)), "a binary, b binary")


def links(docs: DataFrame, classes: DataFrame, threshold: int = 85, cut: float = 0.70, block: int = BLOCK) -> DataFrame:
    """Confirmed links (a, b) that join all classes with 100 * intersection >= threshold * union."""
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(bands_for(threshold))))
    bands = classes.select("cls", F.explode(keys).alias("key"))
    centres = bands.groupBy("key").agg(F.min("cls").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = bands.join(centres, "key").where("cls <> centre").select(F.col("cls").alias("a"), F.col("centre").alias("b"))
    groups = components(stars).withColumnsRenamed({"node": "cls", "component": "grp"})
    weight = 1 + F.floor(F.col("n_shingles") / LONG)
    sizes = groups.join(classes.select("cls", "n_shingles"), "cls").groupBy("grp").agg(F.sum(weight).alias("size"))
    member = written(groups.join(sizes, "grp").join(classes, "cls"), "members")

    wanted = member.select(F.col("first_id").alias("of"), F.lit(True).alias("hit")).distinct()
    wanted = F.broadcast(wanted) if member.count() <= BROADCAST_IDS else wanted.hint("shuffle_hash")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").select("text")
    sets = texts.mapInArrow(released(_sets), "cls binary, shingles binary")
    rows = member.join(sets, "cls").withColumns({"blocks": F.ceil(F.col("size") / block), "component": F.col("cls"), "part": F.lit(0)})
    rows = rows.select("grp", "cls", "component", "part", "size", "blocks", "n_shingles", "registers", "shingles")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    centre = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("cls", F.lit(3)), F.ceil(F.col("size") / 16)) == 0)
    large = member.where(F.col("size") > block).limit(1).count() > 0
    if large:  # full sets are needed twice
        rows = written(rows, "member-sets")
    dealt = rows.select("*", F.explode(F.when(centre, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"), F.lit(True).alias("query"))
    found = written(_linked(dealt, threshold, cut), "links")
    if large:
        known = components(found).withColumnsRenamed({"node": "cls", "component": "now"})
        wide = rows.where("blocks > 1").join(known, "cls", "left").withColumn("component", F.coalesce("now", "cls")).drop("now")
        counts = wide.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"))
        main = counts.groupBy("grp").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
        few = main.count() <= BROADCAST_IDS
        near = F.broadcast if few else (lambda df: df.hint("shuffle_hash"))
        wide = wide.join(near(main), "grp").withColumn("query", F.col("component") != F.col("main"))
        left = wide.groupBy("grp").agg(F.ceil(F.sum(F.when(F.col("query"), weight).otherwise(0)) / block).alias("parts")).where("parts > 0")
        wide = wide.join(near(left), "grp")
        every = wide.withColumn("query", F.lit(False)).withColumn("block", own).drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
        asked = wide.where("query").drop("part").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("parts")).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        more = written(_linked(every.unionByName(asked, allowMissingColumns=True), threshold, cut), "links")
        found = found.unionByName(more)
        forget(rows)
    return found


def _labelled(docs: DataFrame, threshold: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id of every row."""
    docs = docs.withColumn("mark", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = written(docs.mapInArrow(released(_classes(ROWS * bands_for(threshold))), f"doc_id {kind}, mark long, n_shingles long, cls binary, registers binary"), "sketches")
    classes = written(sketched.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")), "classes")
    linked = components(links(docs, classes, threshold, cut_for(threshold))).withColumnsRenamed({"node": "cls"})
    of = classes.join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls")).select("cls", "component", "first_id", "copies")
    of = written(of, "class-components")
    named = of.groupBy("component").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("members")).where("members > 1")
    of = of.join(named, "component").select("cls", "component_id")
    return sketched.join(of, "cls", "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links), kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _labelled(docs, threshold).select(
        F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def deduplicate(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Rows that repeat an id and its text
    are one document; documents without words all stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _labelled(rows, threshold)
    keyed = found.groupBy("doc_id", "mark").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
    keyed = keyed.withColumn("again", F.col("doc_id").eqNullSafe(F.col("c"))).where("n > 1 or not again").select(F.col("doc_id").alias("__cl_of"), F.col("mark").alias("__cl_had"), F.col("again").alias("__cl_again"))
    keyed = written(keyed, "dropped")
    small = keyed.count() <= BROADCAST_IDS

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df.hint("shuffle_hash")

    same = F.col(id_col).eqNullSafe(F.col("__cl_of")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__cl_had"))
    again = docs.join(side(keyed.where("__cl_again")), same, "left_semi").withColumn("__cl_mark", F.xxhash64(text_col)).dropDuplicates([id_col, "__cl_mark"]).drop("__cl_mark")
    return docs.join(side(keyed), same, "left_anti").unionByName(again)
