"""Token files of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one; a bitmap
beside it tells which of its ids go on to level k + 1, and a rank directory holds the ones of the bitmap before each
512 bits. Token i is read in one step a level: its chunk, its bit, and the rank of that bit as position a level up.
Nothing else is decoded.

File (little-endian): magic ``DACT1``, documents n (u64), tokens t (u64), levels (u8); n + 1 token offsets (u64); n ids
(i64) and n bytes that are 1 where the id is null; then each level: ids m (u64), m chunk bytes, and but for the last
level the bitmap in 64-bit words and the directory (u64 for every 8 words).

Files hold ascending ranges of doc_id, null first; rows of an equal id are ordered by a hash of the text. Null and empty
texts hold the end id alone; a text of any length is encoded whole, and a file is closed behind the document that fills
it. An empty table gives no file. Other columns aren't read, whatever their names. A file is written under a name of its
own and then renamed, so a repeated or speculative task replaces it whole.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filesystem, give_back, released, remembered, split_words, written

MAGIC, END = b"DACT1", 1
#: Chunks that a worker remembers: so many new ones, and as many older ones. Bytes of the longest. Marks for chunks that
#: came once.
MEMORY, REMEMBERED, DOOR = 400_000, 64, 1 << 22
#: Ids of a file, about; files that a task reads, one after another.
FILE_TOKENS, FILES_A_TASK = 2_000_000, 4
#: Fixed value: the words of the tokenizers that are encoded by chunk.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MANIFEST = "part long, number long, name string, docs long, tokens long"

# --- the codec


def pack(ids: np.ndarray) -> list[bytes]:
    """The levels of ``ids`` (unsigned 32-bit), each as bytes."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        level = struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes()
        if not more.any():
            return [*out, level]
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(rest) // 64), "<u8")
        words.view(np.uint8)[: len(bits)] = bits
        ones = np.bitwise_count(words).astype(np.uint64)
        ranks = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)))[:-1][::8]
        out.append(level + words.tobytes() + ranks.astype("<u8").tobytes())
        rest = rest[more] >> np.uint32(8)


class TokenFile:
    """Reads a token file's bytes; ``self[i]`` is any token without decoding others."""

    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.tokens, n_levels = struct.unpack_from("<QQB", data, 5)
        at = 22
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, at)
        at += 8 * (self.n + 1)
        self.doc_ids = np.frombuffer(data, "<i8", self.n, at)
        at += 8 * self.n
        self.nulls = np.frombuffer(data, np.uint8, self.n, at)
        at += self.n
        self.levels = []
        for k in range(n_levels):
            (m,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, m, at + 8)
            at += 8 + m
            words = ranks = None
            if k < n_levels - 1:
                n_words = -(-m // 64)
                words = np.frombuffer(data, "<u8", n_words, at)
                ranks = np.frombuffer(data, "<u8", -(-n_words // 8), at + 8 * n_words)
                at += 8 * n_words + 8 * len(ranks)
            self.levels.append((chunks, words, ranks))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for k, (chunks, words, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if words is None:
                break
            word, bit = divmod(i, 64)
            if not int(words[word]) >> bit & 1:
                break
            i = int(ranks[word // 8]) + int(np.bitwise_count(words[word // 8 * 8 : word]).sum()) + (int(words[word]) & ((1 << bit) - 1)).bit_count()
        return value

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        values = None
        for chunks, words, _ in reversed(self.levels):
            level = chunks.astype(np.uint32)
            if words is not None:
                more = np.unpackbits(words.view(np.uint8), count=len(chunks), bitorder="little").view(bool)
                level[more] |= values << np.uint32(8)
            values = level
        return values

    def document(self, k: int) -> np.ndarray:
        return np.array([self[i] for i in range(int(self.offsets[k]), int(self.offsets[k + 1]))], np.uint32)


def file_bytes(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    return whole_file(doc_ids, np.array([len(x) for x in ids], np.int64), np.concatenate(ids) if ids else np.zeros(0, np.uint32))


def whole_file(doc_ids: list, sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """A file of documents with ``sizes`` ids each, all ids behind one another."""
    offsets = np.concatenate((np.zeros(1, np.uint64), np.cumsum(sizes, dtype=np.uint64)))
    levels = pack(flat)
    return b"".join(
        (
            MAGIC, struct.pack("<QQB", len(doc_ids), len(flat), len(levels)), offsets.astype("<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), *levels,
        )
    )


# --- the encoder

#: A chunk that is one word of plain or Latin-1 letters with marks behind it; and words, digits and runs of marks in any
#: order. Marks are such that no special token and no split of the tokenizer's words starts with one.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)([.,;:!?|#$%&*()/=+_-]*)")
_PIECES = re.compile(r"([A-Za-zÀ-ÖØ-Þß-öø-ÿ]+)|([0-9])|([.,;:!?|#$%&*()/=+_-]+)")
_PIECED = re.compile(rf"(?:{_PIECES.pattern})+")


def _byte_letters() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Encoder(dict):
    """Encodes whole texts with the tokenizers library, a chunk between ASCII white space at a time.

    Where the tokenizer drops white space and splits words before merging, chunks are encoded alike alone and in a
    text; the loaded file is asked whether it does, and any other tokenizer gets whole texts. Short chunks repeat and
    are remembered in the worker. A chunk of one word is given to the library's model directly, lower-cased as its
    normaliser does; every other chunk goes through the library's whole encoding.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[bytes, bytes] = {}
        self.door, self.came = bytearray(DOOR), 0
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_chunk = _by_chunk(self.tokenizer)
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        word = word.lower()
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _mark(self, run: str) -> bytes:
        """A digit or a run of marks; the short ones are few and remembered."""
        ids = self.marks.get(run)
        if ids is None:
            ids = self._whole(run)
            if len(run) <= 3:
                self.marks[run] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            text = chunk.decode()
            m = _SIMPLE.fullmatch(text)
            if m:
                ids = self._word(m[1])
                if m[2]:
                    ids += self._mark(m[2])
            elif _PIECED.fullmatch(text):
                ids = b"".join(self._word(w) if w else self._mark(n or run) for w, n, run in _PIECES.findall(text))
            else:
                ids = self._whole(text)
        place = hash(chunk) & (DOOR - 1)
        if len(chunk) > REMEMBERED:
            return ids
        if not self.door[place]:  # most chunks never come again: only the second time is remembered
            self.door[place] = 1
            self.came += 1
            if 2 * self.came > DOOR:
                self.door, self.came = bytearray(DOOR), 0
            return ids
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` behind one another, and how many each has; null is empty. Chunks are looked up once."""
        if not self.by_chunk:
            parts = [self._whole(t.as_py()) if t.is_valid else b"" for t in texts]
            return np.frombuffer(b"".join(parts), np.uint32), np.array([len(p) // 4 for p in parts], np.int64)
        distinct, code, counts = split_words(texts)
        ids = list(map(self.__getitem__, distinct))
        pool = np.frombuffer(b"".join(ids), np.uint32)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        del distinct, ids
        starts = np.cumsum(lengths) - lengths
        size = lengths[code]
        ends = np.cumsum(size)
        at = np.repeat(starts[code] - ends + size, size)
        at += np.arange(len(at))
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return pool[at], np.diff(upto)


def _by_chunk(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, drops white space, and splits words into byte letters before merging."""
    normalizer, splitter = ({} if x is None else json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    steps = normalizer.get("normalizers", [])
    split, *rest = splitter.get("pretokenizers", [{}])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and split.get("pattern") == {"Regex": PATTERN} and split["behavior"] == "Removed" and split["invert"]
        and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)]
        and type(tokenizer.model).__name__ == "BPE" and not tokenizer.model.dropout and not tokenizer.truncation and not tokenizer.padding
    )


def encoder(path: str) -> Encoder:
    return remembered(f"encoder {path}", lambda: Encoder(path))


# --- the job


def _write(folder: str, tokenizer_path: str, end_id: int, file_tokens: int):
    """Encodes rows in their order; a file is closed at ``file_tokens`` ids, so memory holds the ids of one file and of one
    batch of rows, and no texts but that batch's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, number = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        fs, root = filesystem(folder)
        doc_ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            name = f"{part:08d}-{number:05d}.dact"
            draft = f"{root}/.{name}.{uuid.uuid4().hex}"
            sizes, flat = (np.concatenate(x) for x in zip(*held))
            with fs.open_output_stream(draft) as f:
                f.write(whole_file(doc_ids, sizes, flat))
            fs.move(draft, f"{root}/{name}")
            doc_ids.clear()
            held.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, number, name, len(sizes), len(flat)), kinds)], ["part", "number", "name", "docs", "tokens"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            flat, sizes = code.encode_all(batch.column("text"))
            flat, sizes = np.insert(flat, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
            ends, at = np.cumsum(sizes), 0
            while at < len(ids):
                before = int(ends[at - 1]) if at else 0
                room = file_tokens - sum(len(x) for _, x in held)
                upto = min(int(np.searchsorted(ends, before + room)) + 1, len(ids))  # the document that fills the file is its last
                held.append((sizes[at:upto], flat[before : int(ends[upto - 1])]))
                doc_ids += ids[at:upto]
                if int(ends[upto - 1]) - before >= room:
                    yield close()
                    number += 1
                at = upto
            give_back(cycles=False)
        if held:
            yield close()

    return run


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    shard = TokenFile(f.read())
                ids, at = shard.all().astype("<u4"), shard.offsets.astype(np.int64)
                ends = list(zip(at[:-1].tolist(), at[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls.astype(bool)), pa.array(at[:-1] + base), pa.array(np.diff(at)),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in ends], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END, shard_rows: int = 8192, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes ``docs`` (doc_id, text) as token files into ``folder`` and returns the manifest: part, number, name, docs,
    tokens, and base, the tokens of all files before.

    Documents are dealt by ranges of (doc_id, hash of the text), at most about ``shard_rows`` rows a range, so a null or
    repeated id that fills a third of the table is split as well. Spark sorts each range and may spill; a task streams
    its range into files of about ``file_tokens`` ids. Nothing but samples of the sort key reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    count = rows.count()
    shards = max(1, -(-count // shard_rows), min(spark.sparkContext.defaultParallelism * 4, -(-count // 256)))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).drop("tie")
    files = written(dealt.mapInArrow(released(_write(folder, tokenizer_path, end_id, file_tokens)), MANIFEST), "token-manifest")
    return _with_base(files)


def _with_base(files: DataFrame, together: int = 1024) -> DataFrame:
    """The manifest with the tokens before each file: summed inside groups of parts, and over the few groups."""
    grouped = files.withColumn("grp", F.floor(F.col("part") / together))
    inside = Window.partitionBy("grp").orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(F.lit(0)).orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    before = grouped.groupBy("grp").agg(F.sum("tokens").alias("all")).select("grp", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    return grouped.withColumn("base", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, "grp").withColumn("base", F.col("base") + F.col("before")).drop("grp", "before")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    tasks = max(1, -(-manifest.count() // FILES_A_TASK))
    return manifest.repartition(tasks).mapInArrow(released(_read(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")
