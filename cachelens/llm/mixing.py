"""Mixing sources to target weights: budgets for a tree, and seeded token prefixes of its leaves.

A token budget flows from the root of a tree (domain, language, source) to the leaves. Each node deals its budget to
its children by weight; a child can take no more than its leaves' tokens times ``epochs``. What a child can't take is
dealt to its siblings by their weights, and only what all of them can't take stays with the ancestors, who have dealt
by the same rule.

A leaf's stream is its documents in a seeded order, anew for each epoch; the leaf takes the prefix of that stream that
its budget allows, whole epochs first, and cuts the last document at a word. Tokens are words between white space.

Null texts and texts without words have no tokens and are never taken. Null levels are nodes of their own. Weights are
relative; missing weights are 1, negative or null ones 0. Equal ids are ordered by a hash of the text; rows equal in
both are one document with several rows, taken together. Very long texts are counted and cut like others. An empty table
or budget gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, released, written


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def share_out(budget: float, children: dict, capacity: dict, weight: dict) -> dict:
    """Deals ``budget`` by weight; shortages go to siblings that can take more, until none can."""
    given, left, open_ = dict.fromkeys(children, 0.0), min(budget, sum(capacity[c] for c in children)), {c for c in children if weight[c] > 0}
    while left > 1e-9 and open_:
        total = sum(weight[c] for c in open_)
        full = {c for c in open_ if given[c] + left * weight[c] / total >= capacity[c]}
        if not full:
            for c in open_:
                given[c] += left * weight[c] / total
            return given
        for c in full:
            left -= capacity[c] - given[c]
            given[c] = capacity[c]
        open_ -= full
    return given


def leaf_budgets(available: dict[tuple, int], weights: dict[tuple, float], budget: int, epochs: float) -> dict[tuple, int]:
    """Whole tokens for each leaf (a path of the tree), given its tokens, the weight of any path, and the root's budget.

    A leaf can spend only if all weights on its path are positive. What rounding down leaves is dealt one token each, to
    the largest fractions first.
    """
    paths = {leaf[:k] for leaf in available for k in range(1, len(leaf) + 1)}
    weight = {p: max(0.0, (1.0 if p not in weights else weights[p]) or 0.0) for p in paths}
    capacity, children = dict.fromkeys(paths, 0.0), {}
    for p in paths:
        children.setdefault(p[:-1], []).append(p)
    for leaf, tokens in available.items():
        nodes = [leaf[:k] for k in range(1, len(leaf) + 1)]
        for p in nodes if all(weight[p] > 0 for p in nodes) else ():
            capacity[p] += tokens * epochs
    given: dict[tuple, float] = {(): float(budget)}
    for path in sorted(children, key=len):
        given |= share_out(given[path], dict.fromkeys(children[path]), capacity, weight)
    whole = {leaf: int(given[leaf] + 1e-6) for leaf in available}
    left = int(sum(given[leaf] for leaf in available) + 1e-6) - sum(whole.values())
    for leaf in sorted(available, key=lambda x: (whole[x] - given[x], *((n is not None, n or "") for n in x)))[:left]:
        whole[leaf] += 1
    return whole


#: Bits of a document's place in a stream. Buckets are ranges of it, so a stream's order is that of the places alone.
KEY_BITS = 60


def stream_key(seed: int, epoch: Column, id_: Column) -> Column:
    """A document's place in its leaf's stream of an epoch: the first 15 hexadecimal digits of an MD5."""
    named = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


RESERVED = ("cl_tokens", "cl_hash", "cl_epoch", "cl_taken", "cl_id", "cl_of", "cl_took")


def _aside(docs: DataFrame) -> dict[str, str]:
    """Other names for columns that are called as this operator's own; ``prefixed`` gives the old ones back."""
    return {c: f"_own_{c}" for c in docs.columns if c.lower() in RESERVED or c.lower().startswith("cl_level")}


def mix(docs: DataFrame, levels: list[Column], weights: dict[tuple, float] | float = 0.7, budget: int | float = 0.9, epochs: int = 2, seed: int = 20_240_701, id_col: str = "doc_id", text_col: str = "text", bucket_docs: int = 1024) -> DataFrame:
    """``docs`` once per epoch in which it is taken, with cl_epoch (from 0), cl_tokens (of the text) and cl_taken.

    Own columns of the names in RESERVED are put aside as ``_own_`` and their name. ``budget``: tokens, or a share (float)
    of all tokens. ``weights``: by path, or an exponent that damps each node's own tokens. The tree has one row per leaf on the driver, and so grows with the sources and not with documents.

    A leaf may hold a third of all rows, so its order is never sorted in one task: hash buckets of some
    ``bucket_docs`` documents are summed, their running sums are taken over the bucket table, and only buckets that
    the budget cuts are ordered inside.
    """
    spark = docs.sparkSession
    docs = docs.withColumnsRenamed(_aside(docs))
    names = [f"cl_level{k}" for k in range(len(levels))]
    base = docs.withColumn("cl_hash", F.xxhash64(text_col))
    counted = base.select(F.col(id_col).alias("id"), "cl_hash", token_count(F.col(text_col)).alias("cl_tokens"), *(c.cast("string").alias(n) for c, n in zip(levels, names)))
    slim = written(counted.where("cl_tokens > 0"), "mix-tokens")
    leaves = slim.groupBy(*names).agg(F.sum("cl_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    available = {tuple(r[n] for n in names): r.tokens for r in leaves}
    total = sum(available.values())
    if isinstance(weights, (int, float)):
        own: dict[tuple, float] = {}
        for leaf, tokens in available.items():
            for k in range(1, len(leaf) + 1):
                own[leaf[:k]] = own.get(leaf[:k], 0) + tokens
        weights = {p: t**weights for p, t in own.items()}
    target = int(budget * total) if isinstance(budget, float) else budget
    given = leaf_budgets(available, weights, target, epochs)
    rows = []
    for k, r in enumerate(leaves):
        path = tuple(r[n] for n in names)
        whole, rest = divmod(given[path], r.tokens)
        buckets = max(1, -(-r.n // bucket_docs))
        rows += [(*path, k, e, buckets, int(r.tokens)) for e in range(whole)] + ([(*path, k, whole, buckets, int(rest))] if rest else [])
    plan_schema = ", ".join(f"{n}_ string" for n in names) + ", leaf int, cl_epoch int, buckets int, allowed long"
    plan = F.broadcast(spark.createDataFrame(rows, plan_schema).coalesce(1))
    on = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]

    bucket = F.shiftright(F.shiftright("key", KEY_BITS // 2) * F.col("buckets"), KEY_BITS // 2)
    dealt = slim.join(plan, on).withColumn("key", stream_key(seed, F.col("cl_epoch"), F.col("id"))).withColumn("bucket", bucket)
    dealt = dealt.groupBy("leaf", "cl_epoch", "bucket", "key", "id", "cl_hash", "allowed").agg(F.sum("cl_tokens").alias("tokens"), F.first("cl_tokens").alias("each"))
    sums = written(dealt.groupBy("leaf", "cl_epoch", "bucket", "allowed").agg(F.sum("tokens").alias("in_bucket")), "mix-buckets")
    before = Window.partitionBy("leaf", "cl_epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    cut = sums.where((F.col("before") < F.col("allowed")) & (F.col("before") + F.col("in_bucket") > F.col("allowed"))).drop("in_bucket", "allowed")
    taken_whole = sums.where(F.col("before") + F.col("in_bucket") <= F.col("allowed")).select("leaf", "cl_epoch", "bucket")
    at = ["leaf", "cl_epoch", "bucket"]
    whole = dealt.join(taken_whole, at, "left_semi").select("id", "cl_hash", "cl_epoch", "each", F.col("tokens").alias("taken"))
    inside = Window.partitionBy(*at).orderBy("key", "id", "cl_hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    partly = dealt.join(F.broadcast(cut), at).withColumn("taken", F.least("tokens", F.col("allowed") - start)).where("taken > 0")
    chosen = whole.unionByName(partly.select("id", "cl_hash", "cl_epoch", "each", "taken"))
    chosen = chosen.select(F.col("id").alias("cl_id"), F.col("cl_hash").alias("cl_of"), "cl_epoch", F.col("each").alias("cl_tokens"), F.col("taken").alias("cl_took"))
    out = base.join(chosen.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("cl_id")) & (F.col("cl_hash") == F.col("cl_of")))
    return out.withColumn("cl_taken", F.least("cl_tokens", "cl_took")).drop("cl_id", "cl_of", "cl_hash", "cl_took")


def _cut(text_at: str):
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, n in zip(batch.column(text_at).to_pylist(), batch.column("cl_taken").to_pylist()):
                raw = text.encode()
                texts.append(raw[: next(islice(word.finditer(raw), n - 1, None)).end()].decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_at else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def prefixed(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mixed documents with each text cut to the words taken; a text taken whole stays as it is."""
    cut = mixed.where("cl_taken < cl_tokens").mapInArrow(released(_cut(text_col)), mixed.schema)
    out = mixed.where("cl_taken >= cl_tokens").unionByName(cut).drop("cl_epoch", "cl_tokens", "cl_taken")
    return out.withColumnsRenamed({c: c.removeprefix("_own_") for c in out.columns if c.startswith("_own_cl_")})
