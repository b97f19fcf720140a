import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cachelens.llm import decontam, katz, mixing, near_dup, quality_classifier, quality_rules, token_counts, token_files, toxicity, warc
from cachelens.llm.common import shared_path, ship

from .corpus import CLASHES, SCHEMA, clashing, documents, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return documents(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(got, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in got)


# --- 2


def brute_stats(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_text_stats():
    texts = [r[1] for r in rows()] + ["a b c a b c", "a a a a", "x\n\nx\n x\nx", "# |a|\n<b>&%$*", "a b\nc a b\nc"]
    for t in texts:
        assert quality_rules.text_stats(t) == brute_stats(t)


def test_quality_rules(docs):
    got = quality_rules.quality_rules(docs, min_docs=5, share=0.1).collect()
    host_docs = collections.Counter(r[3] for r in rows())
    on = collections.Counter((r[3], k) for r in rows() for k in quality_rules.line_words(r[1]))
    common = {x for x, n in on.items() if n > max(5, 0.1 * host_docs[x[0]])}
    want = collections.Counter()
    for r in rows():
        s = brute_stats(r[1])
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        gone = sum(n for k, n in quality_rules.line_words(r[1]).items() if (r[3], k) in common)
        want[(r[0], *s, failed, not failed and s[0] - gone >= 50 and s[0] - gone >= 0.5 * s[0], gone)] += 1
    assert any(x[-1] for x in want)
    assert pairs(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words") == want


def test_quality_rules_shuffled_lines(docs, monkeypatch):
    a = quality_rules.quality_rules(docs, min_docs=5).collect()
    monkeypatch.setattr(quality_rules, "BROADCAST_LINES", -1)
    assert collections.Counter(a) == collections.Counter(quality_rules.quality_rules(docs, min_docs=5).collect())


# --- 1


def test_labellers_recover_accuracies():
    rng = np.random.default_rng(0)
    names = list(quality_classifier.LABELLERS)
    good = rng.random(5000) < 0.7
    acc = np.linspace(0.65, 0.95, len(names))
    right = rng.random((5000, len(names))) < acc
    vote = np.where(rng.random(right.shape) < 0.2, "0", np.where(right == good[:, None], "+", "-"))
    model = quality_classifier.fit_labellers(collections.Counter("".join(v) for v in vote))
    assert abs(model["share"] - 0.7) < 0.03
    assert np.abs(model["rates"][1, :, 2] - acc).max() < 0.05


def brute_em(patterns, rounds=100):
    """The same model, document by document, in plain Python."""
    n, k = len(patterns), len(quality_classifier.LABELLERS)
    post = [min(max(sum("-0+".index(c) - 1 for c in p) / k * 0.5 + 0.5, 0.02), 0.98) for p in patterns]
    for _ in range(rounds):
        rate = []
        for y in (0, 1):
            of = [{c: 0.1 + sum((q if y else 1 - q) for p, q in zip(patterns, post) if p[j] == c) for c in "-+"} for j in range(k)]
            rate.append([{c: v[c] / (v["-"] + v["+"]) for c in "-+"} | {"0": 1.0} for v in of])
        share, new = (sum(post) + 1) / (n + 2), []
        for p in patterns:
            bad, good = (math.prod(rate[y][j][c] for j, c in enumerate(p)) * s for y, s in ((0, 1 - share), (1, share)))
            new.append(good / (good + bad))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-6
        if done:
            break
        post = new
    return new


def test_em_equals_brute_force(docs):
    patterns = [quality_classifier.votes(quality_classifier.measures(r[1])) for r in rows()]
    model = quality_classifier.fit_labellers(collections.Counter(patterns))
    assert np.allclose(quality_classifier.posterior_of(model, patterns), brute_em(patterns), atol=1e-6)


def test_scorer_equals_brute_force():
    rng = np.random.default_rng(2)
    x, y = rng.random((30, 6)).astype(np.float32), rng.random(30)
    w, b = quality_classifier.fit_scorer(x, y, steps=20)
    v, c, m, s, mc, sc = [0.0] * 6, 0.0, [0.0] * 6, [0.0] * 6, 0.0, 0.0
    for t in range(1, 21):
        error = [1 / (1 + math.exp(-sum(a * q for a, q in zip(r, v)) - c)) - float(g) for r, g in zip(x.tolist(), y)]
        grad = [sum(e * r[j] for e, r in zip(error, x.tolist())) / 30 + 1e-4 * v[j] for j in range(6)]
        gc = sum(error) / 30
        m, s = [0.9 * a + 0.1 * g for a, g in zip(m, grad)], [0.999 * a + 0.001 * g * g for a, g in zip(s, grad)]
        mc, sc = 0.9 * mc + 0.1 * gc, 0.999 * sc + 0.001 * gc * gc
        step = lambda a, q: 0.1 * (a / (1 - 0.9**t)) / (math.sqrt(q / (1 - 0.999**t)) + 1e-8)  # noqa: E731, B023
        v, c = [a - step(g, q) for a, g, q in zip(v, m, s)], c - step(mc, sc)
    assert np.allclose(w, v, atol=1e-3) and abs(b - c) < 1e-3


def test_quality_does_not_depend_on_order_or_copies(spark):
    made = [(k, f"this is text number{k} of the corpus, and it has words of some kind " * (1 + k % 3) + "!" * (k % 5)) for k in range(300)]
    made += [(1000 + k, made[7][1]) for k in range(200)]  # copies that are drawn all together, or not at all
    df = spark.createDataFrame(made, "doc_id long, text string")
    one = {r.doc_id: r.cl_score for r in quality_classifier.classify(df.coalesce(1), sample_rows=100).collect()}
    two = {r.doc_id: r.cl_score for r in quality_classifier.classify(df.repartition(13).orderBy(F.desc("doc_id")), sample_rows=100).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-9


def test_quality_classifier(spark, docs, empty):
    long = " ".join(f"the word{i} of this and that" for i in range(30)) + "."
    bad = ["$$$ *** ### " * 60, "go " * 300, "BUY!! NOW!! CHEAP!! " * 40]
    made = spark.createDataFrame([(i, f"{long} {i}") for i in range(60)] + [(100 + i, f"{t} {i}") for i, t in enumerate(bad * 5)], "doc_id long, text string")
    got = {r.doc_id: r.cl_kept for r in quality_classifier.classify(made).collect()}
    assert all(got[i] for i in range(60)) and not any(got[100 + i] for i in range(15))
    out = quality_classifier.classify(docs)
    assert out.count() == len(rows()) and all(r.cl_kept for r in out.where("text is null or trim(text) = ''").collect())
    assert quality_classifier.classify(empty).count() == 0


# --- 3


def test_codes_are_directly_addressable():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), rng.integers(0, 255, 1000), rng.choice([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1], 5000)):
        ids = ids.astype(np.uint32)
        f = token_files.TokenFile(token_files.file_bytes([None, 7], [ids[:10], ids[10:]]))
        assert (f.all() == ids).all() and [f[i] for i in range(0, len(ids), 7)] == ids[::7].tolist()
        assert f.document(0).tolist() == ids[:10].tolist()
    with pytest.raises(IndexError):
        f[5000]
    with pytest.raises(ValueError):
        token_files.TokenFile(b"other file")


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["It's I'LL", "H̱ ẖ İ ΑΣ ß", "<|endoftext|>x <|startoftext|", "..!? |a| 12ab", "日本 🙂", "\x1c\x85 a\x00b", "ª º µ"]
    code = token_files.Encoder(path)
    rng = np.random.default_rng(4)
    letters = list("abTS'’`.,;:!?|#$%&*()/=+_-<>~0189éÉßµ×÷ªÿ \u0301日🙂") + ["<|endoftext|>", "'s", "'ll"]
    texts += ["".join(rng.choice(letters, int(rng.integers(1, 12)))) for _ in range(20_000)]
    for t in texts:
        assert code.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    folder = shared_path(spark, "t")
    got = token_files.read_tokens(token_files.write_tokens(docs, folder, path, shard_rows=16), folder).collect()
    ties = {r.row: r.tie for r in docs.select(F.struct("doc_id", "text").alias("row"), F.xxhash64("text").alias("tie")).collect()}
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, ties[r[0], r[1]]))
    want, at = collections.Counter(), 0
    for r in ordered:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want[(r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert pairs(got, "doc_id", "start", "n_tokens", "ids_crc32") == want
    small = token_files.write_tokens(clashing(spark), folder + "s", path, shard_rows=16, file_tokens=300)  # files of a few documents
    assert small.count() > 30 and pairs(token_files.read_tokens(small, folder + "s").collect(), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_files.read_tokens(token_files.write_tokens(empty, folder + "e", path), folder + "e").count() == 0


def test_token_files_of_another_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    code, library = token_files.Encoder(path), Tokenizer.from_file(path)
    for t in ["Two  Words, it's", " lead\n\n\ttail ", "É日"]:
        assert code.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_one_id_in_thousands_of_files(spark):
    folder, n = shared_path(spark, "t"), 1_000
    docs = spark.range(n).select(F.lit(7).alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    files = token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), shard_rows=2, file_tokens=1)
    assert files.select("part").distinct().count() > 300 and files.count() == n
    got = sorted((r.start, r.n_tokens) for r in token_files.read_tokens(files, folder).collect())
    assert len(got) == n and all(a + size == b for (a, size), (b, _) in zip(got, got[1:]))


# --- 4


def test_arc_versions_convert_alike():
    records = [{"url": "http://a.b/c d", "payload": b"x\n\ny", "date": "20010203040506"}, {"url": None, "payload": b""}]
    one, two = (list(warc.parse_arc(warc.arc_file(records, v))) for v in (1, 2))
    assert [r["payload"] for r in one] == [r["payload"] for r in two] == [b"x\n\ny", b""]
    assert one[0]["url"] == "http://a.b/c%20d" and warc.warc_date(one[0]["date"]) == "2001-02-03T04:05:06Z"
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_arc(warc.arc_file(records[:1], 1)[:-3]))
    with pytest.raises(ValueError, match="version block"):
        list(warc.parse_arc(b"http://x 0.0.0.0 20010203040506 text/html 0\n\n"))


def test_warc(spark):
    page = [(1, "http://a", "same"), (2, "http://b c", "same"), (3, None, None), (4, "u", ""), (5, "v", "own\r\n\r\n"), (None, "w", "same"), (9, "é", "é" * 70_000), (5, "v", "own\r\n\r\n"), (2, "z", "same")]
    pages = spark.createDataFrame([(*p, 0, "x") for p in page], "page_id long, url string, html string, winner int, digest string")
    for version in (1, 2):
        folder = shared_path(spark, "w")
        got = warc.read_warc(warc.pages_to_warc(pages, folder, version, file_bytes=50), folder).collect()
        want = collections.Counter()
        for i, _, h in page:
            raw = (h or "").encode()
            top = max((p[0] for p in page if (p[2] or "") == (h or "") and p[0] is not None), default=None)
            want[(i, len(raw), warc.payload_digest(raw), "response" if i == top else "revisit", None if i == top else top)] += 1
        assert pairs(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.read_warc(warc.pages_to_warc(pages.limit(0), folder, 1), folder).count() == 0
    assert all(r.record_type == "response" for r in warc.read_warc(warc.pages_to_warc(pages, folder + "x", 1, least=10**6), folder + "x").collect())
    by_id = {r.page_id: r for r in got if r.record_type == "response"}
    assert all(r.refers_to_record == by_id[r.refers_to].record_id for r in got if r.record_type == "revisit")


def test_archives(spark, tmp_path):
    import gzip

    big = b"x" * (9 << 20)
    records = [{"url": f"http://h/{k % 7}", "payload": big if k == 5 else b"text %d" % (k % 4), "date": f"2001020304050{k % 10}", "type": "text/plain", "ip": "1.2.3.4"} for k in range(20)]
    (tmp_path / "a.arc").write_bytes(warc.arc_file(records[:12], 1))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(warc.arc_file(records[12:], 2)))
    folder = shared_path(spark, "w")
    got = warc.read_warc(warc.archives_to_warc(spark, f"file://{tmp_path}/*.arc*", folder), folder).collect()
    ids = [k if k < 12 else (1 << 32) + k - 12 for k in range(20)]
    last = {r["payload"]: i for r, i in zip(records, ids)}
    want = {i: (len(r["payload"]), warc.payload_digest(r["payload"]), "response" if last[r["payload"]] == i else "revisit", r["url"], warc.warc_date(r["date"])) for r, i in zip(records, ids)}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.target_uri, r.warc_date) for r in got} == want
    record = {r.page_id: r.record_id for r in got}
    assert all(r.refers_to_record == record[r.refers_to] for r in got if r.record_type == "revisit")


def test_a_file_begins_with_warcinfo(spark):
    import gzip

    from cachelens.llm.common import filesystem

    folder = shared_path(spark, "w")
    files = warc.pages_to_warc(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), folder).collect()
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/{files[0].name}", compression=None) as f:
        records = list(warc.parse_warc(gzip.GzipFile(fileobj=f)))
    assert [h["WARC-Type"] for h, _ in records] == ["warcinfo", "response"] and records[1][1] == b"text"


# --- 5


def test_toxicity_is_learnt_and_ignores_group_names(spark, docs, empty):
    group = ["muslim", "gay", "black", "women"]
    text = lambda i: " ".join(f"w{(i * k) % 97}" for k in range(1, 30))
    made, label = [], []
    for i in range(600):
        toxic = i % 4 == 0
        named = group[i % 3] if toxic or i % 9 == 0 else ""
        made.append((i, text(i) + (" you idiotic fools " if toxic else " ") + named))
        label.append((i, int(toxic)))
    made += [(1000 + k, f"{text(k)} {g} people") for k, g in enumerate(group)] + [(2000, None), (2001, "")]
    df, labels = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(label, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == label[i][1] for i in held]) > 0.97
    assert all(got[1000 + k].predicted == 0 for k in range(4))
    scored = toxicity.score_toxicity(docs, labels.withColumn("text", F.lit(1))).collect()
    assert len(scored) == len(rows()) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_toxicity_screen_is_the_same_over_any_tasks(spark):
    made = [(f"common words in text {k} " + ("vile" if k % 5 == 0 else "kind"), int(k % 5 == 0)) for k in range(40)]
    train = spark.createDataFrame(made, "text string, toxic int")
    want = collections.defaultdict(lambda: [0, 0])
    for text, toxic in made:
        for f in set(toxicity.grams(toxicity.normalised(text)).tolist()):
            want[f][toxic] += 1
    for tasks in (1, 40):
        out = train.repartitionByRange(tasks, "text").mapInArrow(toxicity._screen, "feature long, clean long, toxic long")
        got = out.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()
        assert {r.feature: [r.clean, r.toxic] for r in got} == dict(want)


def test_toxicity_does_not_depend_on_partitions(spark):
    made = [(k, f"plain words {k} " + ("you vile fool " if k % 3 == 0 else "you kind friend ") + ("women " if k % 4 == 0 else "") + f"end{k % 11}") for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    df = spark.createDataFrame(made, "doc_id long, text string")
    scores = [{r.doc_id: r.score for r in toxicity.score_toxicity(df.repartition(n, "doc_id"), labels).collect()} for n in (1, 7, 211)]
    assert all(s.keys() == scores[0].keys() and max(abs(s[k] - scores[0][k]) for k in s) < 1e-9 for s in scores)


def test_toxicity_fit_equals_brute_force():
    from types import SimpleNamespace as Row

    rng = np.random.default_rng(6)
    made = []
    for k in range(40):
        x = sorted(set(rng.integers(0, 8, 4).tolist()))
        made.append(Row(toxic=int(rng.random() < 0.4), x=x, swapped=sorted(set(rng.integers(0, 8, 4).tolist())) if k % 3 else None))
    w, b = toxicity.fit(made, 8, pairing=0.5, l1=1e-3, steps=30)
    dense = lambda s: np.isin(np.arange(8), s).astype(float)
    x, y = np.array([dense(r.x) for r in made]), np.array([r.toxic for r in made], float)
    gap = np.array([dense(r.x) - dense(r.swapped) for r in made if r.swapped is not None])
    v = np.append(np.zeros(8), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m = s = np.zeros(9)
    for t in range(1, 31):
        error = 1 / (1 + np.exp(-(x @ v[:8] + v[8]))) - y
        g = np.append(x.T @ error / len(y) + 0.5 * 2 * gap.T @ (gap @ v[:8]) / len(gap), error.mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        rate = 0.1 / (np.sqrt(s / (1 - 0.999**t)) + 1e-3)
        v = v - rate * m / (1 - 0.9**t)
        v[:8] = np.sign(v[:8]) * np.maximum(np.abs(v[:8]) - 1e-3 * rate[:8] * 0.1, 0)
    assert np.allclose(w, v[:8], atol=1e-9) and abs(b - v[8]) < 1e-9


def test_pairing_evens_out_swapped_terms():
    from types import SimpleNamespace as Row

    # feature 0: an insult; 1 and 2: two group names, the first of which stands beside most insults
    made = [Row(toxic=1, x=[0, 1], swapped=[0, 2])] * 20 + [Row(toxic=0, x=[2], swapped=[1])] * 40 + [Row(toxic=0, x=[3], swapped=None)] * 40 + [Row(toxic=0, x=[1], swapped=[2])] * 2
    plain, even = toxicity.fit(made, 4, 0.0)[0], toxicity.fit(made, 4, 10.0)[0]
    assert abs(even[1] - even[2]) < 0.3 * abs(plain[1] - plain[2]) and even[0] > 1


def test_swaps():
    assert toxicity.swapped(b" the muslim women ") == b" the christian men "
    assert toxicity.swapped(b" blackboard ") is None


# --- 6


def test_budgets():
    available = {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 1000}
    assert mixing.leaf_budgets(available, {}, 100, 1) == {("a", "x"): 40, ("a", "y"): 10, ("b", "x"): 50}
    assert mixing.leaf_budgets(available, {}, 600, 1) == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 490}
    assert mixing.leaf_budgets(available, {("b",): 0.0}, 600, 2) == {("a", "x"): 200, ("a", "y"): 20, ("b", "x"): 0}
    assert mixing.leaf_budgets(available, {}, 10**6, 3) == {k: 3 * v for k, v in available.items()}
    assert mixing.leaf_budgets({("a", "x"): 100, ("b", "y"): 1000}, {("a", "x"): 0.0}, 500, 1) == {("a", "x"): 0, ("b", "y"): 500}
    assert sum(mixing.leaf_budgets({(c,): 100 for c in "abcdefg"}, {}, 200, 1).values()) == 200
    many = {(f"d{k % 50}", f"s{k}"): 1 + k % 97 for k in range(20_000)}
    assert sum(mixing.leaf_budgets(many, {}, 500_000, 1).values()) == 500_000


def poured(leaves, weight, budget, epochs):
    """Budgets by pouring: the root's tokens go down the tree in small portions, by weight, to whoever can still take some."""
    from fractions import Fraction

    given = dict.fromkeys(leaves, Fraction(0))
    room = {leaf: Fraction(n * epochs) for leaf, n in leaves.items()}

    def open_(p):
        return [leaf for leaf in leaves if leaf[: len(p)] == p and all(weight.get(leaf[:k], 1) > 0 for k in range(1, len(leaf) + 1)) and given[leaf] < room[leaf]]

    def rates(p):
        kids = sorted({leaf[: len(p) + 1] for leaf in open_(p)} - {p})
        if not kids:
            return {p: Fraction(1)}
        total = sum(Fraction(weight.get(c, 1)) for c in kids)
        return {leaf: Fraction(weight.get(c, 1)) / total * x for c in kids for leaf, x in rates(c).items()}

    left = Fraction(budget)
    while left > 0 and open_(()):
        rate = rates(())
        step = min([left, *((room[k] - given[k]) / x for k, x in rate.items())])
        for k, x in rate.items():
            given[k] += step * x
        left -= step
    return given


def test_budgets_equal_pouring():
    rng = np.random.default_rng(8)
    for _ in range(40):
        leaves = {(f"a{i}", f"b{j}", f"c{k}"): int(rng.integers(1, 60)) for i in range(3) for j in range(2) for k in range(int(rng.integers(1, 4)))}
        weight = {p[:n]: int(rng.integers(0, 4)) for p in leaves for n in (1, 2, 3)}
        epochs, budget = int(rng.integers(1, 4)), int(rng.integers(0, 700))
        got, want = mixing.leaf_budgets(leaves, weight, budget, epochs), poured(leaves, weight, budget, epochs)
        assert all(abs(got[k] - want[k]) < 1.001 for k in leaves) and sum(got.values()) == int(sum(want.values()))


@pytest.mark.parametrize("bucket_docs", [4096, 2])
def test_mix(docs, empty, bucket_docs):
    levels = [F.col("lang"), F.col("source")]
    got = mixing.mix(docs, levels, budget=0.8, epochs=3, bucket_docs=bucket_docs, weights=0.3).collect()
    leaf = lambda r: (r[2], r[3])
    leaf_of = lambda r: (r.lang, r.source)
    available = collections.Counter()
    for r in rows():
        available[leaf(r)] += len(WORD.findall(r[1] or ""))
    available = {k: v for k, v in available.items() if v}
    own = collections.Counter()
    for k, v in available.items():
        own[k[:1]] += v
        own[k] += v
    want = mixing.leaf_budgets(available, {p: t**0.3 for p, t in own.items()}, int(0.8 * sum(available.values())), 3)
    taken = collections.Counter()
    for r in got:
        taken[(r.lang, r.source)] += r.cl_taken
        assert 0 < r.cl_taken <= r.cl_tokens == len(WORD.findall(r.text))
    repeated = leaf(rows()[20])  # rows of one document are taken together and cut alike
    assert {k: v for k, v in taken.items() if k != repeated} == {k: v for k, v in want.items() if v and k != repeated}
    whole, expected = {}, collections.Counter()
    for k, budget in want.items():  # the documents of a leaf in the order of their MD5s, an epoch after the other
        once = {(r[0], r[1]) for r in rows() if leaf(r) == k and WORD.findall(r[1] or "")}
        n = {d: sum((r[0], r[1]) == d and leaf(r) == k for r in rows()) * len(WORD.findall(d[1])) for d in once}
        for epoch in range(3):
            place = lambda d: int(hashlib.md5(f"20240701|{epoch}|{'' if d[0] is None else d[0]}".encode()).hexdigest()[:15], 16)
            for d in sorted(once, key=lambda d: (place(d), d[0] or 0, d[1])):
                took = min(n[d], budget)
                budget -= took
                whole[k, epoch, d] = took
        assert budget == 0
    for r in got:
        expected[leaf_of(r), r.cl_epoch, (r.doc_id, r.text)] = r.cl_taken
    assert {x: min(t, len(WORD.findall(x[2][1]))) for x, t in whole.items() if t and x[2][0] != 20} == {x: t for x, t in expected.items() if x[2][0] != 20}
    cut = collections.Counter((r.lang, r.source, r.cl_epoch) for r in got if r.cl_taken < r.cl_tokens)
    assert max((n for k, n in cut.items() if k[:2] != repeated), default=0) <= 1
    assert got == mixing.mix(docs, levels, budget=0.8, epochs=3, bucket_docs=bucket_docs, weights=0.3).collect() or collections.Counter(got) == collections.Counter(mixing.mix(docs, levels, budget=0.8, epochs=3, bucket_docs=bucket_docs, weights=0.3).collect())
    assert mixing.mix(empty, levels).count() == 0 and mixing.mix(docs, levels, budget=0).count() == 0


def test_mixed_texts_are_prefixes(docs):
    mixed = mixing.mix(docs, [F.col("lang")], budget=0.5, epochs=1)
    text = {r[0]: r[1] for r in rows() if r[0] != 20}
    want = {r.doc_id: r.cl_taken for r in mixed.collect()}
    for r in mixing.prefixed(mixed).collect():
        if r.doc_id in text and r.doc_id is not None:
            assert text[r.doc_id].startswith(r.text) and len(WORD.findall(r.text)) == want[r.doc_id]


# --- 7


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, docs, empty, name):
    path = public_tokenizers.path(name)
    texts = [r[1] or "" for r in rows()] + ["a  b", " lead", "trail ", "x▁y ▁", "<s> </s> <unk>", "a\nb\t c", "🙂 日本語 word"]
    c = token_counts.PieceCounter(path)
    assert c.counts(texts) == c.whole(texts) == c.counts(texts)
    cache = shared_path(spark, "cache")
    part = token_counts.count_tokens(docs.where("doc_id < 30"), cache, path).collect()
    assert len(part) == sum(r[0] is not None and r[0] < 30 for r in rows())
    got = token_counts.count_tokens(docs, cache, path, limit=500).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()), n, n > 500) for r, n in zip(rows(), c.whole([r[1] or "" for r in rows()])))
    assert pairs(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in rows()})
    assert token_counts.count_tokens(empty, cache, path).count() == 0
    rows_ = spark.createDataFrame(stored.select("digest", "n_tokens").collect(), "digest binary, n_tokens long")
    rows_.write.mode("append").parquet(f"{cache}/tokenizer={token_counts.tokenizer_digest(path)}")  # as two runs at a time would
    again = token_counts.count_tokens(clashing(spark), cache, path, limit=500).collect()
    assert pairs(again, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_filled_cache_encodes_nothing(spark, docs, monkeypatch):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), shared_path(spark, "cache")
    first = collections.Counter(token_counts.count_tokens(docs, cache, path).collect())

    def forbidden(path):
        def run(batches):
            for batch in batches:
                assert not batch.num_rows
                yield batch.select(["digest"]).append_column("n_tokens", pa.array([], pa.int64()))

        return run

    import pyarrow as pa

    monkeypatch.setattr(token_counts, "_encode", forbidden)
    assert collections.Counter(token_counts.count_tokens(docs, cache, path).collect()) == first


# --- 8


def brute_contamination(text, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, t in items:
        ws = word.findall((t or "").translate(LOWER))
        k = min(size, len(ws))
        windows = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if ws else set()
        for j in range(len(words) - k + 1):
            if tuple(words[j : j + k]) in windows:
                hit.update(range(j, j + k))
                found.add(str(i))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_contamination(spark, docs, empty, block_words):
    text = {r[0]: r[1] for r in rows()}
    w = text[40].split()
    items = [(1, " ".join(text[15].split()[:14])), (2, " ".join(w[3:9])), (3, "one two three"), (4, None), (5, "..."), (6, text[60]), (7, text[60]), (8, "ka ka ka ka ka ka ka ka ka ka ka ka"), (9, "zzdu"), (10, " ".join(text[15].split()[5:30]))]
    item = spark.createDataFrame(items, "item_id long, text string")
    matched = decontam.match_spans(docs.select("doc_id", "text"), item, block_words=block_words)
    got = matched.mapInArrow(decontam._digest, decontam.contamination(docs, item).schema).collect()
    want = collections.Counter((r[0], *brute_contamination(r[1], items)) for r in rows())
    assert pairs(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert decontam.contamination(empty, item).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(docs, item.limit(0)).collect())


def test_decontaminate(spark, docs):
    text = {r[0]: r[1] for r in rows()}
    leak = text[15].split()[:12]
    item = spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string")
    made = spark.createDataFrame([(1, "before it, " + " ".join(leak).upper() + "; behind it " + "word " * 20), (2, " ".join(leak) + " x"), (3, "clean, whole."), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontam.decontaminate(made, item).collect()}
    assert got == {1: "before it, ; behind it " + "word " * 20, 3: "clean, whole.", 4: None}
    assert decontam.decontaminate(docs, item).columns == docs.columns


# --- 9


def brute_components(docs, threshold=85):
    sets = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a][1] and 100 * len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return collections.Counter((i, len(s), least.get(find(k), i), i == least.get(find(k), i)) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("block", [2000, 4])
def test_near_duplicates(docs, empty, block, monkeypatch):
    monkeypatch.setattr(near_dup.links, "__defaults__", (85, 0.70, block))
    got = near_dup.near_duplicates(docs).collect()
    want = brute_components([(r[0], r[1]) for r in rows()])
    assert sum(n for x, n in want.items() if not x[3]) >= 10
    assert pairs(got, "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("monkey", [{"near_dup": {"BROADCAST_IDS": -1}}, {"components": {"BROADCAST_EDGES": -1}}])
def test_near_duplicates_without_broadcasts(docs, monkey, monkeypatch):
    from cachelens.llm import components

    for module, values in monkey.items():
        for name, value in values.items():
            monkeypatch.setattr({"near_dup": near_dup, "components": components}[module], name, value)
    monkeypatch.setattr(near_dup.links, "__defaults__", (85, 0.70, 4))
    want = brute_components([(r[0], r[1]) for r in rows()])
    assert pairs(near_dup.near_duplicates(docs).collect(), "doc_id", "n_shingles", "component_id", "kept") == want
    assert {r.doc_id for r in near_dup.deduplicate(docs).collect()} == {x[0] for x in want if x[3]}


@pytest.mark.parametrize("threshold, edits", [(85, 3), (80, 4)])
def test_recall_near_the_threshold(spark, threshold, edits):
    made = []
    for k in range(400):  # pairs of similarity 0.858 (three edits) and 0.815 (four)
        base = [f"p{k}w{j}" for j in range(200)]
        made += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(f"x{j}" if j % 40 == 20 and j // 40 < edits else w for j, w in enumerate(base)))]
    got = near_dup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), threshold=threshold).collect()
    found = sum(r.component_id == r.doc_id - 1 for r in got if r.doc_id % 2)
    assert found == 400 and all(r.kept for r in got if r.doc_id % 2 == 0)


def test_deduplicate(docs, empty):
    left = near_dup.deduplicate(docs)
    assert left.columns == docs.columns
    want = {x[0] for x in brute_components([(r[0], r[1]) for r in rows()]) if x[3]}
    got = left.collect()
    assert {r.doc_id for r in got} == want
    assert len(got) == len({(r.doc_id, r.text) for r in got})
    assert near_dup.deduplicate(empty).count() == 0


def test_pipeline_drops_near_copies_from_80(spark):
    import corpus_pipeline

    made = []
    for k in range(40):  # each with copies at 0.917, 0.841, 0.771 and 0.705
        base = [f"t{k}w{j}" for j in range(120)]
        made.append((10 * k, " ".join(base)))
        for n in (1, 2, 3, 4)[k % 4 :]:
            made.append((10 * k + n, " ".join(f"e{n}" if j in range(10, 10 + 25 * n, 25) else w for j, w in enumerate(base))))
    kept = {at: {x[0] for x in brute_components(made, at) if x[3]} for at in (80, 85)}
    assert len(kept[85]) >= len(kept[80]) + 10
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(made, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == kept[80]


def test_bands_follow_the_threshold():
    assert near_dup.bands_for(85) == near_dup.BANDS == near_dup.bands_for(100)
    assert all((1 - (t / 100) ** near_dup.ROWS) ** near_dup.bands_for(t) <= 1e-6 for t in (60, 70, 80, 85, 95))
    s = np.arange(1, 900, dtype=np.uint64)
    assert (near_dup.sketch(s, 175)[: near_dup.REGISTERS] == near_dup.sketch(s)).all()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**63, 900).astype(np.uint64), rng.integers(0, 2**63, 100).astype(np.uint64)
    both = near_dup.sketch(np.concatenate((x, y)))
    assert (np.maximum(near_dup.sketch(x), near_dup.sketch(y)) == both).all()
    assert 0.8 < (near_dup.sketch(x) == both).mean() < 0.98
    a = near_dup.sketch(x)
    equal, more = np.array([(a == both).sum()]), np.array([(both < a).sum()])
    assert near_dup.may_reach(equal, more, 900.0, np.array([1000.0]), 0.7)[0]
    assert not near_dup.may_reach(equal, more, 900.0, np.array([1000.0]), 0.98)[0]


# --- 10


def brute_katz(docs, held, k=5):
    toks = [[*(t or "").encode().lower().split(), "END"] for _, t in docs]
    one, two, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for ws, h in zip(toks, held):
        if not h:
            one.update(ws)
            two.update(zip(["START", *ws], ws))
            hist.update(["START", *ws[:-1]])
    n, vocabulary = sum(one.values()), len(one)

    def discounts(counts):
        f = collections.Counter(counts.values())
        d = {r: 1.0 for r in range(1, k + 1)}
        if f[1]:
            base = (k + 1) * f[k + 1] / f[1]
            for r in range(1, k + 1):
                if f[r] and base < 1:
                    x = ((r + 1) * f[r + 1] / (r * f[r]) - base) / (1 - base)
                    d[r] = x if 0 < x <= 1 else 1.0
        return lambda c: d.get(c, 1.0)

    d1, d2 = discounts(one), discounts(two)
    mass = sum(d1(c) * c for c in one.values()) / n if n else 0.0
    scale, unknown = (1.0, 1 - mass) if n and mass < 1 - 1e-12 else (n / (n + 1), 1 / (n + 1))
    p1 = lambda w: scale * d1(one[w]) * one[w] / n if one[w] else unknown
    after = collections.defaultdict(list)
    for v, w in two:
        after[v].append(w)

    def p2(w, v):
        if v not in after:
            return p1(w)
        left = 1 - sum(d2(two[v, x]) * two[v, x] for x in after[v]) / hist[v]
        s, left = (1.0, left) if left > 1e-12 else (hist[v] / (hist[v] + 1), 1 / (hist[v] + 1))
        if two[v, w]:
            return s * d2(two[v, w]) * two[v, w] / hist[v]
        return left / (1 - sum(map(p1, after[v]))) * p1(w)

    for v in [*list(after)[:8], "START"]:
        if v in after:
            assert abs(sum(p2(w, v) for w in [*one, "never seen"]) - 1) < 1e-9
    out = []
    for (i, _), ws, h in zip(docs, toks, held):
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (vocabulary + 1))) for w in ws)
        out.append((i is None, i or 0, h, len(ws), sum(one[w] > 0 for w in ws), n, base, sum(math.log10(p2(w, v)) for v, w in zip(["START", *ws], ws))))
    return sorted(out)


@pytest.mark.parametrize("size", [(64 << 20, 2_000_000), (500, 300)])
def test_katz(docs, empty, size):
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    corpus = katz.Corpus(docs, ~held, *size)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.score(corpus, katz.train(corpus)).collect())
    want = brute_katz([(r[0], r[1]) for r in rows()], [fold(r[0]) for r in rows()])
    assert [x[:6] for x in got] == [x[:6] for x in want]
    assert np.allclose([x[6:] for x in got], [x[6:] for x in want], rtol=1e-9)
    none = katz.Corpus(empty, ~held)
    assert katz.score(none, katz.train(none)).count() == 0


def brute_backoff(docs, held, order, k=5):
    """Scores by the recursive definition, n-grams as tuples."""
    toks = [["START", *(t or "").encode().lower().split(), "END"] for _, t in docs]
    count, after = collections.Counter(), collections.defaultdict(set)
    for ws, h in zip(toks, held):
        for j in range(1, len(ws) if not h else 0):
            for n in range(1, min(order, j + 1) + 1):
                count[tuple(ws[j - n + 1 : j + 1])] += 1
                after[tuple(ws[j - n + 1 : j])].add(ws[j])
    size = {h: sum(count[*h, w] for w in ws) for h, ws in after.items()}
    discount = [None]
    for n in range(1, order + 1):
        f = collections.Counter(c for g, c in count.items() if len(g) == n)
        d, base = {}, (k + 1) * f[k + 1] / f[1] if f[1] else 1
        for r in range(1, k + 1):
            x = ((r + 1) * f[r + 1] / (r * f[r]) - base) / (1 - base) if f[r] and base < 1 else 1.0
            d[r] = x if 0 < x <= 1 else 1.0
        discount.append(d)
    known, freed = {}, {}

    def seen(h, w):
        c = count[*h, w]
        return discount[len(h) + 1].get(c, 1.0) * c

    def left(h):
        if h not in freed:
            x = 1 - sum(seen(h, w) for w in after[h]) / size[h]
            freed[h] = (1.0, x) if x > 1e-12 else (size[h] / (size[h] + 1), 1 / (size[h] + 1))
        return freed[h]

    def p(w, h):
        if h not in size:
            return p(w, h[1:])
        if (h, w) not in known:
            scale, x = left(h)
            if w in after[h]:
                known[h, w] = scale * seen(h, w) / size[h]
            else:
                known[h, w] = x / (1 - sum(p(y, h[1:]) for y in after[h])) * p(w, h[1:]) if h else x
        return known[h, w]

    for h in [g for g in after if len(g) == order - 1][:8]:
        assert abs(sum(p(w, h) for w in [*after[()], "never seen"]) - 1) < 1e-9
    score = lambda ws: sum(math.log10(p(ws[j], tuple(ws[max(0, j - order + 1) : j]))) for j in range(1, len(ws)))
    return sorted((i is None, i or 0, len(ws) - 1, score(ws)) for (i, _), ws in zip(docs, toks))


@pytest.mark.parametrize("order, size", [(3, (64 << 20, 2_000_000)), (3, (500, 300)), (4, (5000, 3000)), (1, (5000, 3000))])
def test_katz_of_order(docs, order, size):
    fold = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows()]
    corpus = katz.Corpus(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, *size)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in katz.score(corpus, katz.train(corpus, order)).collect())
    want = brute_backoff([(r[0], r[1]) for r in rows()], fold, order)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-9)


def test_katz_query_scores_from_two_words(spark, monkeypatch):
    from cachelens.llm import queries

    orders, train = [], katz.train
    monkeypatch.setattr(katz, "train", lambda corpus, order=2: orders.append(order) or train(corpus, order))
    assert queries.op10_katz(spark, "/root/testdata/sf0.001").count() > 0 and orders == [3]


def test_katz_without_training(docs):
    corpus = katz.Corpus(docs, F.lit(False))
    assert all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in katz.score(corpus, katz.train(corpus)).collect())


# --- all


def test_words_are_split_as_bytes_are():
    import pyarrow as pa

    from cachelens.llm.common import split_words

    rng = np.random.default_rng(9)
    letters = list("aBé日 \t\n\x0b\x0c\r\x1c\x85\xa0")
    texts = [None, "", " ", *("".join(rng.choice(letters, int(rng.integers(0, 25)))) for _ in range(3000)), *(r[1] for r in rows())]
    whole = pa.array(texts, pa.string())
    for a, b in [(0, len(texts)), (0, 3), (1, 2), *(sorted(rng.integers(0, len(texts), 2).tolist()) for _ in range(200))]:
        distinct, code, counts = split_words(whole[a:b])
        ends = np.cumsum(counts)
        got = [[distinct[k] for k in code[e - n : e]] for e, n in zip(ends, counts)]
        assert got == [(t or "").encode().split() for t in texts[a:b]]


def test_own_columns_stay(spark, docs):
    own = clashing(spark)
    assert quality_classifier.keep(own).columns == own.columns
    item = spark.createDataFrame([(1, rows()[15][1])], "item_id long, text string")
    mixed = mixing.prefixed(mixing.mix(own, [F.col("lang"), F.col("source")]))
    assert sorted(mixed.columns) == sorted(own.columns)
    for df in (quality_classifier.keep(own), near_dup.deduplicate(own), decontam.decontaminate(own, item), mixed):
        assert df.count() > 0
        assert df.agg(*(F.count_if(F.col(c) != f"own {c}").alias(c) for c in CLASHES)).first() == tuple([0] * len(CLASHES))
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(40)], "doc_id long, toxic int, text string")
    assert toxicity.score_toxicity(own, labels).count() == len(rows())
    assert quality_rules.quality_rules(own).count() == near_dup.near_duplicates(own).count() == len(rows())
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_tokens(own, shared_path(spark, "c"), path).count() == len(rows())
    assert decontam.contamination(own, item).count() == len(rows())
    corpus = katz.Corpus(own, F.lit(True))
    assert katz.score(corpus, katz.train(corpus, 3)).count() == len(rows())
