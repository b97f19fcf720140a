"""Token counts behind a digest cache.

A count is stored under (tokenizer digest, content digest). A run joins the documents' digests to the stored counts,
encodes only the distinct misses, and appends them to the cache, so repeated content and later runs cost a join.

Content is normalised only as far as no count can change: null becomes the empty text, and the digest is taken over
the UTF-8 bytes of the whole text, however long. Null doc_ids, repeated ids and repeated rows each keep their own result
row; equal rows are encoded once. Runs that write to one cache at a time may store a digest twice; it is read as one. Other
columns aren't read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exists, released, remembered

#: Entries of a worker's chunk memory before it is emptied.
MEMORY = 1_000_000


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer by its library and file content, so another vocabulary never reuses counts."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(library.encode() + b"\0" + f.read()).hexdigest()


class PieceCounter:
    """Counts tokens of whole texts exactly as the library encodes them.

    A sentencepiece BPE vocabulary in which no piece holds a space mark behind another character can never merge
    across "character, space". With the identity normaliser and a dummy prefix, a text without space runs or literal
    marks is therefore the sum of its space-separated chunks, each encoded alone. Chunks repeat, so their counts are
    remembered in the worker; every other text goes to the library whole.
    """

    def __init__(self, path: str):
        self.path, self.memory = path, {}
        if path.endswith(".model"):
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2 as pb

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            spec = pb.ModelProto()
            spec.ParseFromString(self.piece.serialized_model_proto())
            pieces = [self.piece.id_to_piece(i) for i in range(self.piece.vocab_size())]
            self.split = (
                spec.normalizer_spec.name == "identity"
                and spec.normalizer_spec.add_dummy_prefix
                and not spec.normalizer_spec.remove_extra_whitespaces
                and not any(p.lstrip("▁").count("▁") for p in pieces)
            )
        else:
            from tokenizers import Tokenizer

            self.json, self.split = Tokenizer.from_file(path), False

    def whole(self, texts: list[str]) -> list[int]:
        if hasattr(self, "piece"):
            return [len(ids) for ids in self.piece.encode(texts, num_threads=1)] if texts else []
        return [len(e.ids) for e in self.json.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.whole(texts)
        memory, out, chunked = self.memory, [0] * len(texts), []
        if len(memory) > MEMORY:
            memory.clear()
        whole = []
        for i, text in enumerate(texts):
            chunks = text.split(" ")
            if "" in chunks or "▁" in text:
                whole.append(i)
            else:
                chunked.append((i, chunks))
        missing = list({c for _, chunks in chunked for c in chunks if c not in memory})
        memory.update(zip(missing, self.whole(missing)))
        for i, chunks in chunked:
            out[i] = sum(map(memory.__getitem__, chunks))
        for i, n in zip(whole, self.whole([texts[i] for i in whole])):
            out[i] = n
        return out


def counter(path: str) -> PieceCounter:
    return remembered(f"counter {path}", lambda: PieceCounter(path))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        c, done = counter(path), set()  # equal rows of an id lie in one task
        for batch in batches:
            new = {d: k for k, d in enumerate(batch.column("digest").to_pylist()) if d not in done}
            done |= new.keys()
            texts = batch.column("content").take(pa.array(new.values(), pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array(c.counts(texts), pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens, over_limit. New counts are appended to ``cache_path``.

    The text of one row per missing digest (its smallest id) is moved once, dealt by (digest, id) so that copies of
    one text never meet; all else that is shuffled is digests and ids.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), content.alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))
    slim = keyed.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    store = f"{cache_path}/tokenizer={version}"

    def stored() -> DataFrame:
        rows = spark.read.schema("digest binary, n_tokens long").parquet(store)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    first = slim.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    if exists(spark, store):
        first = first.join(stored(), "digest", "left_anti")
    first = first.withColumnRenamed("digest", "first_digest")
    missing = keyed.join(
        first.hint("shuffle_hash"),
        (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")),
        "left_semi",
    )
    new = missing.select("digest", "content").mapInArrow(released(_encode(tokenizer_path)), "digest binary, n_tokens long")
    new.dropDuplicates(["digest"]).write.mode("append").parquet(store)
    return slim.join(stored(), "digest").select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
