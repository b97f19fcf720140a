"""A small hard corpus: nulls, empty and long texts, ties, repeated rows, copies, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cl_score double, votes string, row long, part int, grp string"
#: Names that operators use themselves.
CLASHES = ["cl_kept", "cl_tokens", "cl_took", "cl_level0", "of", "had", "taken", "again", "mark", "cls", "key", "hit", "size", "content", "digest", "id", "tokens", "toxic", "held_out", "component"]


def rows() -> list[tuple]:
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "É", "zz") for b in ("", "ta", "so", "vi", "pe", "du")]
    text = lambda n: " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=n))
    texts = [None, "", " \t\n\x0b", "one", "one two three four", "A\tb\x0cC d", "Ä ä İ ß", "\x00 \x1f x", "ka " * 60]
    texts += [text(rng.randint(5, 220)) for _ in range(40)]
    base = text(120).split()
    for k in range(12):  # near copies
        w = list(base)
        for j in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3])):
            w[j] = f"edit{k}x{j}"
        texts.append(" ".join(w))
    texts += [texts[12]] * 5 + ["shared line of several words\n" + text(80) for _ in range(30)] + [text(30_000)]
    out = [(i, t, "en" if i % 3 else "de", f"src{i % 4}" if i % 7 else None, None if t is None else len(t), 0.5, "v", i, 1, "g") for i, t in enumerate(texts)]
    out += [(None, texts[10], "en", "src1", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out + [out[20], out[20], (20, "another text under a used id", "en", "src0", 2, 0.1, "w", 3, 2, "h")]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def clashing(spark):
    from pyspark.sql import functions as F

    return documents(spark).withColumns({c: F.lit(f"own {c}") for c in CLASHES})
