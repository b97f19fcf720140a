"""Every stage of the pipeline against a brute-force version on the stage's own input, and on hard tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cachelens.llm import mixing
from cachelens.llm import quality_classifier as quality

from .corpus import rows
from .test_operators import LOWER, WORD, brute_components, brute_em

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def brute_quality(docs):
    values = [quality.measures(d.text) for d in docs]
    patterns = [quality.votes(v) for v in values]
    posterior = brute_em(patterns)
    texts = {d.text: k for k, d in enumerate(docs)}  # fewer than the sample, so every distinct text is in it
    x = np.array([quality.features(docs[k].text, values[k]).astype(np.float16) for k in texts.values()], np.float32)
    w, b = quality.fit_scorer(x, np.array([posterior[k] for k in texts.values()]))
    score = [float(quality.features(d.text, v) @ w + b) for d, v in zip(docs, values)]
    return {d.doc_id for d, v, s in zip(docs, values, score) if v is None or s >= 0}, {d.doc_id for d, s in zip(docs, score) if abs(s) < 1e-2}


def brute_strip(text, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    at = [m.span() for m in word.finditer((text or "").translate(LOWER))]
    words, hit = [text.translate(LOWER)[a:b] for a, b in at], set()
    for t in items:
        ws = word.findall((t or "").translate(LOWER))
        k = min(size, len(ws))
        windows = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if ws else set()
        hit.update(i for j in range(len(words) - k + 1) if tuple(words[j : j + k]) in windows for i in range(j, j + k))
    if len(hit) > 200 or len(hit) > 0.5 * len(words):
        return None
    out, i = text, len(words) - 1
    while i >= 0:  # from behind, a run of hit words at a time
        if i in hit:
            end = i
            while i - 1 in hit:
                i -= 1
            out = out[: at[i][0]] + out[at[end][1] :]
        i -= 1
    return out


def brute_mix(docs):
    def leaf(d):
        number = re.search("([0-9]+)$", d.source or "")
        return (f"domain{int(number[1]) // 5}" if number else "domain-", d.lang, d.source)

    n = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    available, own = collections.Counter(), collections.Counter()
    for d in docs:
        available[leaf(d)] += n[d.doc_id]
    available = {k: v for k, v in available.items() if v}
    for path, tokens in available.items():
        for k in (1, 2, 3):
            own[path[:k]] += tokens
    budgets = mixing.leaf_budgets(available, {p: t**0.7 for p, t in own.items()}, int(0.9 * sum(available.values())), 2)
    out = collections.Counter()
    for path, budget in budgets.items():
        for epoch in (0, 1):
            place = lambda d: int(hashlib.md5(f"20240701|{epoch}|{d.doc_id}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
            for d in sorted((d for d in docs if leaf(d) == path and n[d.doc_id]), key=place):
                took = min(n[d.doc_id], budget)
                budget -= took
                if took:
                    raw = list(WORD.finditer(d.text))
                    out[d.doc_id, d.text if took == n[d.doc_id] else d.text[: raw[took - 1].end()]] += 1
    return out


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.collect()
    stage = lambda name, df: spark.createDataFrame(STAGE[name](spark, df, FOLDER).collect(), COLUMNS)

    left = stage("quality classifier", docs)
    want, near = brute_quality(before)
    assert {r.doc_id for r in left.collect()} ^ want <= near and len(near) < 5
    before = left.collect()

    left = stage("near-duplicates", left)
    assert {r.doc_id for r in left.collect()} == {x[0] for x in brute_components([(r.doc_id, r.text) for r in before], 80) if x[3]}
    before = left.collect()

    left = stage("benchmark decontamination", left)
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = {r.doc_id: t for r in before if (t := brute_strip(r.text, items)) is not None}
    assert {r.doc_id: r.text for r in left.collect()} == want
    before = left.collect()

    left = stage("mixing", left)
    assert collections.Counter((r.doc_id, r.text) for r in left.collect()) == brute_mix(before)
    assert all(r.n_chars == len(r.text) for r in left.collect())
    before = left.collect()

    got = STAGE["token files"](spark, left, FOLDER).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in before:
        ids = library.encode(r.text, add_special_tokens=False).ids + [1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist()
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in ordered)


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_on_hard_tables(spark, name):
    hard = spark.createDataFrame([r[:5] for r in rows()], COLUMNS)
    out = STAGE[name](spark, hard, FOLDER)
    assert out.count() > 0
    assert name == "token files" or out.columns == hard.columns
    for nothing in (hard.limit(0), hard.where("text is null").withColumn("doc_id", F.lit(None).cast("long"))):
        left = nothing.select("doc_id", "text").distinct().count() if name == "near-duplicates" else nothing.count()
        assert STAGE[name](spark, nothing, FOLDER).count() == (0 if name == "mixing" else left)
    clash = hard.withColumns({c: F.lit(f"own {c}") for c in ("cl_tokens", "cl_kept", "mark", "cls", "of", "had", "tie", "size", "key")})
    out = STAGE[name](spark, clash, FOLDER)
    assert out.count() > 0 and (name == "token files" or sorted(out.columns) == sorted(clash.columns))


def test_run_with_everything_dropped(spark, tmp_path):
    spark.createDataFrame([(1, None, "en", "s1", None), (2, "", "en", "s1", 0)], COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
