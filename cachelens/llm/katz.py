"""Katz backoff language model of words, of any order, over corpora that fit no single machine.

Training counts n-grams up to the order; counts up to K are discounted by Good-Turing, and the mass that discounts free
after a history goes to unseen successors in proportion to their probabilities after the history without its first
word, and so on down to single words. Backoff weights are normalised exactly: after every history, the probabilities of
all known words and of the unknown word sum to one.

    P(w | h) = d(c(h, w)) c(h, w) / c(h)   if the n-gram was seen; h' is h without its first word
             = alpha(h) P(w | h')          if only h was seen
             = P(w | h')                   else;      P(w) = d(c(w)) c(w) / N, and for unknown words what is left

One start stands before a document, so its first words have shorter histories. Where no count of a level (or of one h)
is discounted, its counts are scaled by n / (n + 1), which frees 1 / (n + 1). Discounts that Good-Turing can't give (a
frequency of frequencies of 0, or a value outside (0, 1]) are 1.

Texts are read once and kept as blocks: files of word hashes and local numbers in the shared folder. Words and n-grams
get numbers: words by frequency, n-grams by their row in the table of the partition that counts them. An n-gram lies
where its history was counted; successors of histories with a large share of all tokens are spread. For each order in
turn a block sends its distinct n-grams, as numbers of history and word, to their partitions. These add them up and
answer with counts, with the numbers that the next order needs, and with the sums of those histories whose backoff
weights a score needs. Both sides keep n-grams in the order of their words' numbers, so numbers travel as short steps and
answers as bare columns.

What can be known without a message is not sent: n-grams whose history or shorter n-gram was not seen are unseen, and
n-grams whose history occurs in one block only are counted there. The tables are Parquet files of (history, word, count):
``grams1`` holds word hashes in the order of their numbers, ``gramsN-partition`` what a partition counts, and
``gramsN-local-block`` what a block counts; there, a negative history -r is row r - 1 of that block's table one order below.

Null and empty texts are the end token alone; texts of any length are read whole, as a block is closed behind the text
that fills it. Repeated rows are trained on and scored each; equal ids stay separate rows. Other columns aren't read,
whatever their names. With no training tokens every probability is the unknown word's, 1. An empty table gives an
empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import filesystem, forget, give_back, shared_path, split_words, written

#: Counts up to K are discounted. UTF-8 bytes of text in a block; tokens of a partition, about.
K, BLOCK_BYTES, PARTITION_TOKENS = 5, 16 << 20, 1_000_000
#: Fixed hash of the end token.
END = 0x656E64
#: Bits of a row number in a partition's table; above them stands by how many partitions the history was spread.
ROW_BITS = 36

# --- packing


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays, each compressed byte plane after byte plane."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        raw = zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1) if len(a) else b""
        parts.append(struct.pack("<2sQQ", a.dtype.str[1:].encode(), len(a), len(raw)) + raw)
    return b"".join(parts)


def _unzip(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<2sQQ", data, at)
        at += 18
        planes = np.frombuffer(zstandard.decompress(data[at : at + size]) if size else b"", np.uint8)
        dtype = np.dtype("<" + kind.decode())
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype))
        at += size
    return out


def _short(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as the narrowest type that holds nearly all of them, and the others, which its top value marks."""
    a = a.astype(np.uint64)
    for kind in (np.uint8, np.uint16, np.uint32):
        top = np.iinfo(kind).max
        over = a >= top
        if 64 * int(over.sum()) <= len(a):
            return np.where(over, top, a).astype(kind), a[over]
    return a, a[:0]


def _long(short: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = short.astype(np.uint64)
    if len(others):
        out[short == np.iinfo(short.dtype).max] = others
    return out.astype(np.int64)


def _bits(a: np.ndarray) -> np.ndarray:
    return np.packbits(a)


def _flags(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, count=n).astype(bool) if n else np.zeros(0, bool)


def _put(folder: str, name: str, data: bytes) -> None:
    fs, root = filesystem(folder)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        f.write(data)
    fs.move(draft, f"{root}/{name}")


def _get(folder: str, name: str) -> list[np.ndarray]:
    fs, root = filesystem(folder)
    with fs.open_input_stream(f"{root}/{name}") as f:
        return _unzip(f.read())


def _table(folder: str, name: str, **columns: np.ndarray) -> None:
    fs, root = filesystem(folder)
    draft = f"{root}/.{name}.{uuid.uuid4().hex}"
    table = pa.table({k: v.astype(np.int64) if v.dtype != np.uint64 else v.view(np.int64) for k, v in columns.items()})
    steps = {c: "DELTA_BINARY_PACKED" if c == "history" else "BYTE_STREAM_SPLIT" for c in columns}
    pq.write_table(table, draft, filesystem=fs, compression="zstd", use_dictionary=False, column_encoding=steps)
    fs.move(draft, f"{root}/{name}")


def _by(part: np.ndarray) -> np.ndarray:
    """Positions ordered by ``part``, equal ones as they stand."""
    return np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")


def _numbered(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``code`` (not negative) in order, and each value's number among them."""
    bits = max(1, len(code) - 1).bit_length()
    if not len(code) or int(code.max()) >> (63 - bits):
        distinct, number = np.unique(code, return_inverse=True)
        return distinct, number.astype(np.int32)
    key = (code << bits) | np.arange(len(code))  # sorted as plain numbers, which is far quicker than by an index
    key.sort()
    at, key = key & ((1 << bits) - 1), key >> bits
    first = np.concatenate(([True], key[1:] != key[:-1]))
    number = np.empty(len(code), np.int32)
    number[at] = np.cumsum(first, dtype=np.int32) - 1
    return key[first], number


# --- blocks


def _blocks(folder: str, block_bytes: int):
    """Writes blocks: ids, null flags, training flags, tokens per document, word hashes, words as local numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        state: dict = {}

        def fresh() -> None:
            state.update(ids=[], train=[], sizes=[], words=[], known={}, size=0)

        def close() -> pa.RecordBatch:
            nonlocal number
            name = f"{part:07d}-{number:05d}"
            number += 1
            local = np.concatenate(state["words"]) if state["words"] else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(local, minlength=len(state["known"])), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, state["known"]), np.uint64, len(order))[order]
            _put(folder, name, _zip(
                np.array([i or 0 for i in state["ids"]], "<i8"), np.array([i is None for i in state["ids"]], "u1"), np.array(state["train"], "u1"),
                *_short(np.array(state["sizes"], np.int64)), hashes.astype("<u8"), *_short(rank[local]),
            ))
            n = np.array(state["sizes"], np.int64) + 1
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(n.sum())]), pa.array([int(n[np.array(state["train"], bool)].sum())]), pa.array([int(sum(state["train"]))])], ["name", "tokens", "train", "docs"])
            fresh()
            return out

        fresh()
        for batch in batches:
            ids, train, texts = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist(), batch.column("text")
            length = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ids):
                before = int(length[at - 1]) if at else 0
                upto = min(int(np.searchsorted(length, before + block_bytes - state["size"])) + 1, len(ids))  # the text that fills it is its last
                known = state["known"]
                distinct, code, counts = split_words(texts[at:upto])
                local = np.fromiter((known.setdefault(w.lower(), len(known)) if w else 0 for w in distinct), np.uint32, len(distinct))
                state["words"].append(local[code])
                state["ids"] += ids[at:upto]
                state["train"] += train[at:upto]
                state["sizes"] += counts.tolist()
                state["size"] += int(length[upto - 1]) - before
                at = upto
                if state["size"] >= block_bytes:
                    yield close()
        if state["ids"]:
            yield close()
        state.clear()
        give_back()

    return run


class Grams:
    """A block's distinct n-grams of one order, in the order of their words. ``history`` and ``lower`` (the n-gram without
    its first word) are positions one order below, ``word`` local numbers; ``times`` counts training tokens, and ``at`` is
    each token's n-gram, -1 where its document starts too near."""

    def __init__(self, history, lower, word, times, at):
        self.history, self.lower, self.word, self.times, self.at = history, lower, word, times, at


class Level:
    """What a block knows of one order: training counts of its n-grams, and which lie in no other block; of each history,
    whether its counts are scaled and its backoff weight, 0 where no score needs it. ``row`` is the n-gram's row in the
    table of partition ``part``; rows are known only while the order above is asked for."""

    def __init__(self, count, own, scaled=None, weight=None, part=None, row=None):
        self.count, self.own, self.scaled, self.weight, self.part, self.row = count, own, scaled, weight, part, row


class Layout:
    """Where n-grams lie: with their history, but successors of histories with over a quarter of a partition's tokens
    are spread over as many partitions as they need."""

    def __init__(self, tokens: int, train: int, partition_tokens: int = PARTITION_TOKENS):
        self.parts = max(1, -(-tokens // partition_tokens))
        self.hot = max(1, train // (4 * self.parts))

    def of_words(self, h: np.ndarray) -> np.ndarray:
        return (h % np.uint64(self.parts)).astype(np.int64)

    def spread(self, count: np.ndarray) -> np.ndarray:
        return np.clip(-(-count // self.hot), 1, self.parts)


def _salt(word: np.ndarray) -> np.ndarray:
    return ((word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _slices(part: np.ndarray) -> dict[int, slice]:
    """Where each partition's run lies in an array ordered by partition."""
    at = np.flatnonzero(np.diff(part, prepend=-1)).tolist() if len(part) else []
    return {int(part[a]): slice(a, b) for a, b in zip(at, [*at[1:], len(part)])}


class Asked:
    """A block's questions of one order, by partition: n-grams ``at`` in runs of one history, and ``bare`` histories that
    are asked for without n-grams. ``flag`` of a run: 0 never wants sums, 1 only if an n-gram of it is unseen, 2 always."""

    def __init__(self, layout: Layout, below: Level, gram: Grams, word_id: np.ndarray):
        known = (below.count > 0) & ~below.own
        maybe = known[gram.history]
        sent = maybe & (below.count[gram.lower] > 0)
        wanted = np.zeros(len(known), bool)
        wanted[gram.history[maybe & ~sent]] = True
        times = layout.spread(below.count)
        hot = times > 1
        at = np.flatnonzero(sent)
        h = gram.history[at]
        salt = np.where(hot[h], _salt(word_id[gram.word[at]]) % times[h], 0)
        part = (below.part[h] + salt) % layout.parts
        if salt.any():
            order = _by(salt)
            order = order[_by(part[order])]
        else:
            order = _by(part)
        self.at, self.part, h, self.salt = at[order], part[order], h[order], salt[order]
        self.first = np.flatnonzero((np.diff(h, prepend=-1) != 0) | (np.diff(self.part, prepend=-1) != 0))
        self.history, self.sizes = h[self.first], np.diff(np.append(self.first, len(h)))
        self.flag = np.where(hot[self.history], 0, np.where(wanted[self.history], 2, 1)).astype(np.uint8)
        self.run_part, self.run_salt = self.part[self.first], self.salt[self.first]
        alone = wanted & ~hot
        alone[self.history] = False
        used = np.zeros(len(known), bool)
        used[gram.history[maybe]] = True
        many = np.flatnonzero(hot & used)
        cold = np.flatnonzero(alone)
        self.bare = np.concatenate((cold, np.repeat(many, times[many])))
        self.bare_salt = np.concatenate((np.zeros(len(cold), np.int64), _steps(times[many])))
        self.bare_part = (below.part[self.bare] + self.bare_salt) % layout.parts
        order = _by(self.bare_salt)
        order = order[_by(self.bare_part[order])]
        self.bare, self.bare_salt, self.bare_part = self.bare[order], self.bare_salt[order], self.bare_part[order]
        self.where = np.full(len(sent), -1, np.int32)
        self.where[self.at] = self.part

    def by_part(self) -> Iterator[tuple[int, slice, slice, slice]]:
        """(partition, its n-grams, its runs, its bare histories)"""
        grams, runs, bare = _slices(self.part), _slices(self.run_part), _slices(self.bare_part)
        for p in sorted(grams.keys() | bare.keys()):
            yield p, grams.get(p, slice(0, 0)), runs.get(p, slice(0, 0)), bare.get(p, slice(0, 0))


def _steps(sizes: np.ndarray) -> np.ndarray:
    """0 ... size - 1 for each of ``sizes``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _rows_of(run_of: np.ndarray, n: int, empty: np.ndarray) -> np.ndarray:
    """Which of ``n`` runs hold an n-gram for which ``empty`` is true."""
    return np.bincount(run_of[empty], minlength=n) > 0


class Block:
    """A block's tokens, and what is known of them up to some order. Local numbers of words follow their numbers: 0 is the
    start, then words and the end by frequency, then words that were never trained on."""

    def __init__(self, corpus: Corpus, model: Model, k: int, rows: list, order: int):
        """Takes in the answers ``rows`` for ``order`` (0: nothing was asked yet); earlier ones lie in the model's folder."""
        self.corpus, self.model, self.layout, self.k = corpus, model, corpus.layout, k
        name = next(data.decode() for _, part, data in rows if part < 0)
        got = {part: _unzip(data) for _, part, data in rows if part >= 0}
        self.ids, self.nulls, train, *packed = _get(corpus.folder, name)
        self.sizes = _long(*packed[:2]) + 1
        hashes, local = packed[2], _long(*packed[3:])
        ends = np.cumsum(self.sizes) - 1
        self.starts = ends - self.sizes + 1
        self.word = np.full(int(self.sizes.sum()), len(hashes), np.int32)
        inner = np.ones(len(self.word), bool)
        inner[ends] = False
        self.word[inner] = local
        self.hashes = np.append(hashes, np.uint64(END))
        self.train_docs = train.astype(bool)
        self.train = np.repeat(self.train_docs, self.sizes)
        self.grams: list[Grams | None] = [None]
        self.levels: list[Level | None] = [None]
        for n in range(1, order + 1):
            if n == 1:
                self._words(got if order == 1 else None)
            else:
                self._add_grams(n)
                self._level(n, got if order == n else None)

    def _file(self, n: int) -> str:
        return f"block-{self.k:07d}-{n}"

    def by_hash(self) -> dict[int, np.ndarray]:
        """Words by partition, in order of their hashes."""
        order = np.argsort(self.hashes, kind="stable")
        part = self.layout.of_words(self.hashes[order])
        order2 = _by(part)
        return {p: order[order2[at]] for p, at in _slices(part[order2]).items()}

    def _words(self, got: dict | None) -> None:
        """Counts and numbers of words; tokens are then numbered by them."""
        size = len(self.hashes)
        if got is None:
            packed = _get(self.model.folder, self._file(1))
            count, number, own = _long(*packed[:2]), _long(*packed[2:4]), _flags(packed[4], size)
        else:
            count, row, own = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
            part = np.zeros(size, np.int64)
            for p, at in self.by_hash().items():
                count[at], row[at], own[at], part[at] = _long(*got[p][:2]), _long(*got[p][2:4]), _flags(got[p][4], len(at)), p
            number = np.where(count > 0, row * self.layout.parts + part, 0)
            _put(self.model.folder, self._file(1), _zip(*_short(count), *_short(number), _bits(own)))
        order = np.argsort(np.where(count > 0, number, np.iinfo(np.int64).max), kind="stable")
        rank = np.empty(size, np.int32)
        rank[order] = np.arange(1, size + 1)
        self.word = rank[self.word]
        first = lambda a, x: np.concatenate(([x], a[order])).astype(a.dtype)
        self.word_id = first(number, 0)
        times = np.bincount(self.word[self.train], minlength=size + 1)
        self.grams.append(Grams(None, None, np.arange(size + 1), times, self.word))
        self.levels.append(Level(first(count, self.model.docs), first(own, False), part=self.word_id % self.layout.parts, row=self.word_id // self.layout.parts))

    def _add_grams(self, n: int) -> None:
        below, width = self.grams[n - 1], len(self.word_id)
        before = np.arange(len(self.word)) - np.repeat(self.starts, self.sizes)  # words of the document before a token
        held = np.flatnonzero(before >= n - 2)
        code = below.at[held - 1].astype(np.int64)
        if n == 2:
            code[before[held] == 0] = 0
        del before
        code *= width
        code += self.word[held]
        distinct, number = _numbered(code)
        del code
        history, word = np.divmod(distinct, width)
        lower = np.empty(len(distinct), np.int32)
        lower[number] = below.at[held]
        at = np.full(len(self.word), -1, np.int32)
        at[held] = number
        times = np.bincount(number[self.train[held]], minlength=len(distinct))
        self.grams.append(Grams(history.astype(np.int32), lower, word.astype(np.int32), times, at))

    def totals(self, n: int) -> np.ndarray:
        """What the counts of order n are divided by, for each history."""
        return self.levels[n - 1].count + self.levels[n].scaled

    def lower_total(self, n: int) -> np.ndarray:
        """What the counts of the shorter n-grams are divided by, for each history of order n."""
        return self.totals(n - 1)[self.grams[n - 1].lower] if n > 2 else np.full(len(self.word_id), self.model.n + (self.model.scale < 1))

    def asked(self, n: int) -> Asked:
        return Asked(self.layout, self.levels[n - 1], self.grams[n], self.word_id)

    def local(self, n: int) -> np.ndarray:
        """N-grams of a history that lies in no other block."""
        below = self.levels[n - 1]
        return (below.own & (below.count > 0))[self.grams[n].history]

    def _level(self, n: int, got: dict | None) -> None:
        gram, below, d = self.grams[n], self.levels[n - 1], self.model.discounts[n]
        size, histories = len(gram.word), len(below.count)
        if got is None:
            packed = _get(self.model.folder, self._file(n))
            at = np.cumsum(_long(*packed[4:6]))
            weight = np.zeros(histories)
            weight[at] = packed[6]
            level = Level(_long(*packed[:2]), _flags(packed[2], size), _flags(packed[3], histories), weight)
            if n < self.model.order:
                level.part = self.asked(n).where
            self.levels.append(level)
            return
        local = self.local(n)
        count = np.where(local, gram.times, 0)
        own, row = local.copy(), np.zeros(size, np.int64)
        kinds, freed, lower, wanted = np.zeros(histories, np.uint8), np.zeros(histories), np.zeros(histories), np.zeros(histories, bool)
        asked = self.asked(n)
        for p, grams, runs, bare in asked.by_part():
            answer = got[p]
            at, h = asked.at[grams], asked.history[runs]
            c = _long(*answer[:2])
            count[at] = c
            of = np.repeat(np.arange(len(h)), asked.sizes[runs])
            wants = (asked.flag[runs] == 2) | ((asked.flag[runs] == 1) & _rows_of(of, len(h), c == 0))
            who = np.concatenate((h, asked.bare[bare]))
            kinds[who] |= answer[2]
            who = np.concatenate((h[wants], asked.bare[bare]))
            sums = [_long(*answer[j : j + 2]) for j in range(3, 3 + 2 * K, 2)]
            wanted[who] = True
            freed[who] += sum((1 - d[r]) * sums[r - 1] for r in range(1, K + 1))
            lower[who] += answer[3 + 2 * K]
            if n < self.model.order:
                seen = at[c > 0]
                row[seen] = np.cumsum(_long(*answer[4 + 2 * K : 6 + 2 * K]))
                own[seen] = _flags(answer[6 + 2 * K], len(seen))
        mine = np.flatnonzero(local & (count > 0))
        if len(mine):
            h, c = gram.history[mine], count[mine]
            small = c <= K
            np.bitwise_or.at(kinds, h[small], (1 << (c[small] - 1)).astype(np.uint8))
            freed += np.bincount(h, c - self.model.discounted(n, c), histories)
            total = self.lower_total(n)[h]
            lower += np.bincount(h, self.model.discounted(n - 1, below.count[gram.lower[mine]]) / total, histories)
        wanted |= below.own & (below.count > 0)
        discounted = sum(1 << (r - 1) for r in range(1, K + 1) if d[r] < 1)
        scaled = (below.count > 0) & (kinds & discounted == 0)
        c = np.maximum(below.count, 1)
        weight = np.where(wanted, np.where(scaled, 1 / (c + 1), freed / c) / np.maximum(1 - lower, 1e-300), 0)
        some = np.flatnonzero(weight)
        _put(self.model.folder, self._file(n), _zip(*_short(count), _bits(own), _bits(scaled), *_short(np.diff(some, prepend=0)), weight[some]))
        self.levels.append(Level(count, own, scaled, weight, asked.where, row))


# --- moving packed rows

ROW = "to int, block int, part int, data binary"


def _row(to: int, block: int, part: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["to", "block", "part", "data"])


def _grouped(work: Callable):
    """Calls ``work(to, rows)`` for the rows of each target, in order of (block, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                rows.setdefault(r["to"], []).append((r["block"], r["part"], r["data"]))
        for to in list(rows):
            yield from work(to, sorted(rows.pop(to)))
        give_back()

    return run


class Model:
    """A trained model: where its tables lie, and the few numbers that are no table. ``discounts`` are by order."""

    def __init__(self, folder: str, n: int, docs: int, order: int):
        self.folder, self.n, self.docs, self.order, self.vocabulary = folder, n, docs, order, 0
        self.discounts = [np.ones(K + 1) for _ in range(order + 1)]
        self.unknown, self.scale = 1.0, 1.0
        self.answers: DataFrame | None = None

    def __getstate__(self):  # what tasks need of it
        return {k: v for k, v in self.__dict__.items() if k != "answers"}

    def discounted(self, order: int, count: np.ndarray) -> np.ndarray:
        return self.discounts[order][np.minimum(count, K + 1) % (K + 1)] * count

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """P(w) for training counts; a count of 0 is the unknown word's probability."""
        p = self.scale * self.discounted(1, count) / max(1, self.n)
        return np.where(count > 0, p, self.unknown)


def good_turing(frequencies: np.ndarray) -> np.ndarray:
    """Discount by count: [1 (counts over K), d(1), ..., d(K)], given n_1 ... n_(K+1)."""
    d = np.ones(K + 1)
    n = np.concatenate(([0.0], frequencies))
    if n[1] > 0:
        base = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and base < 1:
                x = ((r + 1) * n[r + 1] / (n[r] * r) - base) / (1 - base)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


def _frequencies(counts: np.ndarray) -> np.ndarray:
    return np.bincount(counts[(counts > 0) & (counts <= K + 1)].astype(np.int64), minlength=K + 2)[1:]


class Corpus:
    """Documents as blocks, ready for training and scoring."""

    def __init__(self, docs: DataFrame, train: F.Column, block_bytes: int = BLOCK_BYTES, partition_tokens: int = PARTITION_TOKENS):
        self.spark: SparkSession = docs.sparkSession
        self.folder = shared_path(self.spark, "blocks")
        fs, root = filesystem(self.folder)
        fs.create_dir(root, recursive=True)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
        done = written(rows.mapInArrow(_blocks(self.folder, block_bytes), "name string, tokens long, train long, docs long"), "block-list")
        counted = done.withColumn("to", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("name")) - 1)
        self.listed = written(counted.select("to", F.col("to").alias("block"), F.lit(-1).alias("part"), F.col("name").cast("binary").alias("data")), "blocks-numbered")
        r = done.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "train", "docs"))).first()
        self.blocks, tokens, self.train_tokens, self.train_docs = r
        self.layout = Layout(tokens, self.train_tokens, partition_tokens)

    def to_parts(self, rows: DataFrame, work: Callable, schema: str = ROW) -> DataFrame:
        return rows.repartitionById(self.layout.parts, F.col("to")).mapInArrow(_grouped(work), schema)

    def to_blocks(self, rows: DataFrame | None, work: Callable, schema: str = ROW) -> DataFrame:
        """Rows to their blocks; a block's own row tells its file, so blocks that nobody answers are worked on too."""
        every = self.listed if rows is None else rows.unionByName(self.listed)
        return every.repartitionById(max(1, self.blocks), F.col("to")).mapInArrow(_grouped(work), schema)

    def __getstate__(self):  # what tasks need of it
        return {"folder": self.folder, "layout": self.layout}


def _ask_words(corpus: Corpus, model: Model):
    def work(k: int, rows: list) -> Iterator[pa.RecordBatch]:
        block = Block(corpus, model, k, rows, 0)
        times = np.bincount(block.word[block.train], minlength=len(block.hashes))
        for p, at in block.by_hash().items():
            yield _row(p, k, p, _zip(np.diff(block.hashes[at], prepend=np.uint64(0)), *_short(times[at])))

    return work


def _sum_words(folder: str):
    """Sums a partition's words, stores them, and answers each block with the counts and numbers of its words."""

    def work(p: int, rows: list) -> Iterator[pa.RecordBatch]:
        asked = [_unzip(data) for _, _, data in rows]
        sizes = [len(a[0]) for a in asked]
        key, at, blocks = np.unique(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]), return_inverse=True, return_counts=True)
        count = np.bincount(at, np.concatenate([_long(*a[1:]) for a in asked]), len(key)).astype(np.int64)
        order = np.argsort(-count, kind="stable")
        row = np.empty(len(key), np.int64)
        row[order] = np.arange(1, len(key) + 1)
        seen = order[: int((count > 0).sum())]
        _table(folder, f"grams1-{p:07d}.parquet", word=key[seen], count=count[seen])
        yield _row(-1, -1, p, _zip(np.append(_frequencies(count), [(count > 0).sum(), count.sum()]).astype("<i8")))
        for (k, _, _), mine in zip(rows, np.split(at, np.cumsum(sizes)[:-1])):
            c = count[mine]
            yield _row(k, k, p, _zip(*_short(c), *_short(np.where(c > 0, row[mine], 0)), _bits(blocks[mine] == 1)))

    return work


def _ask_grams(corpus: Corpus, model: Model, n: int):
    """A block's distinct n-grams to their partitions: steps between histories, run lengths and flags; numbers of words
    and training counts; for trained n-grams the shorter n-grams' counts and what these are divided by. What the block
    counts itself it stores, and sends its frequencies of counts."""

    def work(k: int, rows: list) -> Iterator[pa.RecordBatch]:
        block = Block(corpus, model, k, rows, n - 1)
        block._add_grams(n)
        gram, below, parts = block.grams[n], block.levels[n - 1], corpus.layout.parts
        mine = block.local(n) & (gram.times > 0)
        yield _row(k % parts, -1, -1, _zip(_frequencies(gram.times[mine]).astype("<i8")))
        if mine.any():
            history = below.row * parts + below.part
            if n > 2:
                inner = block.local(n - 1) & (below.count > 0)
                history = np.where(inner, -np.cumsum(inner), history)
            _table(model.folder, f"grams{n}-local-{k:07d}.parquet", history=history[gram.history[mine]], word=block.word_id[gram.word[mine]], count=gram.times[mine])
        asked, total = block.asked(n), block.lower_total(n)
        for p, grams, runs, bare in asked.by_part():
            at, h = asked.at[grams], asked.history[runs]
            times = gram.times[at]
            trained = _rows_of(np.repeat(np.arange(len(h)), asked.sizes[runs]), len(h), times > 0)
            yield _row(p, k, p, _zip(
                *_short(_key_steps(asked.run_salt[runs], below.row[h])), *_short(asked.sizes[runs]), asked.flag[runs], *_short(block.word_id[gram.word[at]]), *_short(times),
                *_short(below.count[gram.lower[at[times > 0]]]), *_short(total[h[trained]]), *_short(_key_steps(asked.bare_salt[bare], below.row[asked.bare[bare]])),
            ))

    return work


def _key_steps(salt: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Steps between histories: by how many partitions they were spread, then by their rows."""
    return np.diff((salt << ROW_BITS) + row, prepend=0)


def _sum_grams(corpus: Corpus, model: Model, n: int):
    """Sums a partition's n-grams, stores them, and answers each block: counts; kinds of small counts after each history;
    sums of wanted histories; and rows of n-grams and whether no other block has them, if another order follows."""
    parts = corpus.layout.parts

    def work(p: int, rows: list) -> Iterator[pa.RecordBatch]:
        frequencies = sum((_unzip(data)[0] for k, _, data in rows if k < 0), np.zeros(K + 1, np.int64))
        rows = [(k, _unzip(data)) for k, _, data in rows if k >= 0]
        packed = [(k, np.cumsum(_long(*a[:2])), _long(*a[2:4]), a[4], _long(*a[5:7]), _long(*a[7:9]), _long(*a[9:11]), _long(*a[11:13]), np.cumsum(_long(*a[13:15]))) for k, a in rows]
        del rows
        if packed:
            keys, of = _numbered(np.concatenate([x for a in packed for x in (a[1], a[8])]))
            ends = np.cumsum([len(x) for a in packed for x in (a[1], a[8])])[:-1]
            named = np.split(of, ends)
            runs, bare = named[::2], named[1::2]
            history = np.concatenate([np.repeat(r, a[2]) for r, a in zip(runs, packed)])
            word = np.concatenate([a[4] for a in packed])
            times = np.concatenate([a[5] for a in packed])
            width = int(word.max(initial=0)) + 1
            if len(keys) * width >= 1 << 63:
                raise OverflowError("more words than a partition can number")
            history = history.astype(np.int64)
            grams, at = _numbered(history * width + word)
            blocks, count = np.bincount(at), np.bincount(at, times, len(grams)).astype(np.int64)
            seen = count > 0
            row = np.cumsum(seen) - 1
            of_gram, word_of = np.divmod(grams[seen], width)
            salt, index = keys >> ROW_BITS, keys & ((1 << ROW_BITS) - 1)
            _table(model.folder, f"grams{n}-{p:07d}.parquet", history=(index * parts + (p - salt) % parts)[of_gram], word=word_of, count=count[seen])
            frequencies = frequencies + _frequencies(count)
            lower = np.zeros(len(grams))
            trained = times > 0
            below = model.discounted(n - 1, np.concatenate([a[6] for a in packed]))
            total = []
            for r, a in zip(runs, packed):
                of_run = np.repeat(np.arange(len(r)), a[2])
                some = _rows_of(of_run, len(r), a[5] > 0)
                each = np.zeros(len(r), np.int64)
                each[some] = a[7]
                total.append(each[of_run[a[5] > 0]])
            lower[at[trained]] = below / np.concatenate(total)
            c = count[seen]
            sums = [np.bincount(of_gram[c == r], minlength=len(keys)) * r for r in range(1, K + 1)]
            lowers = np.bincount(of_gram, lower[seen], len(keys))
            kinds = sum(((s > 0) << r).astype(np.uint8) for r, s in enumerate(sums))
        yield _row(-1, -1, p, _zip(frequencies.astype("<i8")))
        start = 0
        for r, b, (k, _, sizes, flag, *_) in zip(runs, bare, packed) if packed else ():
            mine = at[start : start + int(sizes.sum())]
            start += len(mine)
            c = count[mine]
            of_run = np.repeat(np.arange(len(r)), sizes)
            wants = np.concatenate((r[(flag == 2) | ((flag == 1) & _rows_of(of_run, len(r), c == 0))], b))
            out = [*_short(c), kinds[np.concatenate((r, b))], *(x for s in sums for x in _short(s[wants])), lowers[wants]]
            if n < model.order:
                known = mine[c > 0]
                out += [*_short(np.diff(row[known], prepend=0)), _bits(blocks[known] == 1)]
            yield _row(k, k, p, _zip(*out))

    return work


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _evaluate(corpus: Corpus, model: Model):
    """Scores a block's documents."""

    def work(k: int, rows: list) -> Iterator[pa.RecordBatch]:
        block = Block(corpus, model, k, rows, model.order)
        count = block.levels[1].count.copy()
        count[0] = 0
        of = np.log10(model.unigram(count))
        log = of[block.word]
        for n in range(2, model.order + 1):
            gram, level, below = block.grams[n], block.levels[n], block.levels[n - 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.log10(model.discounted(n, level.count) / block.totals(n)[gram.history])
                backed = np.where(below.count > 0, np.log10(level.weight), 0)[gram.history] + of[gram.lower]
            of = np.where(level.count > 0, direct, backed)
            log = np.where(gram.at >= 0, of[gram.at], log)
        c = count[block.word]
        base = np.log10((c + 0.5) / (model.n + 0.5 * (model.vocabulary + 1)))
        total = lambda x: np.add.reduceat(x, block.starts)
        n = len(block.ids)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(block.ids, pa.int64(), mask=block.nulls.astype(bool)), pa.array(~block.train_docs), pa.array(block.sizes, pa.int64()), pa.array(total((c > 0).astype(np.int64)), pa.int64()),
                pa.array([model.n] * n, pa.int64()), pa.array(total(base), pa.float64()), pa.array(total(log), pa.float64()),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return work


def _sums(answers: DataFrame, size: int) -> np.ndarray:
    """The partitions' sums, a few numbers each, added up as they arrive."""
    return sum((_unzip(bytes(r.data))[0] for r in answers.where("to < 0").select("data").toLocalIterator()), np.zeros(size, np.int64))


def train(corpus: Corpus, order: int = 2) -> Model:
    """Counts the training documents of ``corpus`` and stores the tables; blocks get what scores of all documents need.
    Only sums of a partition reach the driver."""
    folder = shared_path(corpus.spark, "katz")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    model = Model(folder, corpus.train_tokens, corpus.train_docs, order)
    if not corpus.blocks:
        return model
    answers = written(corpus.to_parts(corpus.to_blocks(None, _ask_words(corpus, model)), _sum_words(folder)), "word-answers")
    sums = _sums(answers, K + 3)
    model.vocabulary = int(sums[K + 1])
    model.discounts[1] = good_turing(sums[: K + 1].astype(float))
    freed = sum((1 - model.discounts[1][r]) * r * sums[r - 1] for r in range(1, K + 1)) / max(1, model.n)
    model.unknown = float(freed) if freed > 0 else 1 / (model.n + 1)
    model.scale = 1.0 if freed > 0 else model.n / (model.n + 1)
    for n in range(2, order + 1):
        asked = corpus.to_blocks(answers.where("to >= 0"), _ask_grams(corpus, model, n))
        before, answers = answers, written(corpus.to_parts(asked, _sum_grams(corpus, model, n)), "gram-answers")
        model.discounts[n] = good_turing(_sums(answers, K + 1).astype(float))
        del asked
        forget(before)
    model.answers = answers
    return model


def score(corpus: Corpus, model: Model) -> DataFrame:
    """One row per document of ``corpus``, on which ``model`` was trained: SCORES."""
    if not corpus.blocks:
        return corpus.spark.createDataFrame([], SCORES)
    return corpus.to_blocks(model.answers.where("to >= 0"), _evaluate(corpus, model), SCORES)
