"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every word sequence that occurs in a test item. Documents are streamed through it word by word,
tracking the longest suffix read so far that occurs in an item; where it reaches the window length, the last words are
a window of some item. Items shorter than a window count as one window.

Null, empty and word-less texts have no words and no hits; null and word-less items are ignored; repeated items each
keep their id, and repeated documents their rows. Without items nothing is hit; an empty table stays empty. Texts are
matched whole, however long. Own columns pass unchanged, whatever their names. Items are taken in blocks of bounded words,
one automaton at a time: each block but the last costs a pass whose result is written, so a large test set takes longer
and never more memory, on the driver or in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, released, remembered, written

#: A-Z to a-z; every other ASCII character that is not a letter or digit becomes a space; UTF-8 bytes over 127 stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Words of one automaton. It is built in each worker from the items' words, some 200 bytes a word.
BLOCK_WORDS = 200_000


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


class Automaton:
    """Generalised suffix automaton of ``items`` (id, words), with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]) for i, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for i, seq in coded:
            state, n = 0, 0
            for c in seq:
                state, n = self.step(state, n, c)
                if n >= window:
                    self.items.setdefault(self.cut(state), set()).add(i)
            if len(seq) < window:
                self.short.setdefault(state, []).append((len(seq), i))
        self.least = min((min(len(s), window) for _, s in coded), default=0)
        # A superset of the word pairs in items, as a bitmap: runs of pairs outside it can't hold a window.
        self.pairs = np.zeros(1 << 22, bool)
        for _, seq in coded:
            a = np.asarray(seq, np.int64)
            self.pairs[self._pair(a)] = True

    @staticmethod
    def _pair(ids: np.ndarray) -> np.ndarray:
        return (ids[:-1] * 1_000_003 + ids[1:]) & ((1 << 22) - 1)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(c)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is not None:
            return self._clone(last, c, known)
        cur = self._add({}, 0, length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _add(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._add(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, n: int, c: int) -> tuple[int, int]:
        """The longest suffix of what was read, with ``c`` behind it, that occurs in an item."""
        while state and c not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, n + 1)

    def cut(self, state: int) -> int:
        """The state of the suffix of exactly one window."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) of hit words, and the items with occurring windows."""
        n_words = len(ws)
        if not self.least or n_words < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, ws, _zeros(n_words)), np.int64, n_words)
        known = ids > 0
        if self.least > 1:
            ok = self.pairs[self._pair(ids)] & known[:-1] & known[1:]
            reach = self.least - 1
        else:
            ok, reach = known, 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        spans, found = [], set()
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start < reach:
                continue
            state = n = 0
            for i, c in enumerate(ids[start : end + (self.least > 1)].tolist(), start):
                state, n = self.step(state, n, c)
                if n >= self.window:
                    found |= self.items[self.cut(state)]
                    _cover(spans, i + 1 - self.window, i + 1)
                if self.short:
                    s, m = state, n
                    while s > 0:
                        for k, item in self.short.get(s, ()):
                            if k <= m:
                                found.add(item)
                                _cover(spans, i + 1 - k, i + 1)
                        s = self.link[s]
                        m = self.length[s]
        return _merged(spans), found


def _zeros(n: int):
    from itertools import repeat

    return repeat(0, n)


def _cover(spans: list[tuple[int, int]], a: int, b: int) -> None:
    if spans and spans[-1][0] <= a <= spans[-1][1]:
        spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
    else:
        spans.append((a, b))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _matcher(items: list[tuple[str, str]], window: int, text_at: str):
    key = (window, hashlib.sha256(repr(items).encode()).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = remembered(f"automaton {key}", lambda: Automaton([(i, words(t)) for i, t in items], window))
        for batch in batches:
            names = batch.schema.names
            before = zip(batch.column("__cachelens_span").to_pylist(), batch.column("__cachelens_item").to_pylist())
            spans, found = [], []
            for text, (old, had) in zip(batch.column(text_at).to_pylist(), before):
                got, ids = automaton.match(words(text))
                flat = [x for pair in _merged(got + list(zip(old[::2], old[1::2]))) for x in pair]
                spans.append(flat)
                found.append(sorted(ids | set(had)))
            columns = [batch.column(n) for n in names if n not in ("__cachelens_span", "__cachelens_item")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                [*(n for n in names if n not in ("__cachelens_span", "__cachelens_item")), "__cachelens_span", "__cachelens_item"],
            )

    return run


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``block_words`` words (a longer item is a block alone), one at least."""
    out, size = [], 0
    for item, text in items.toLocalIterator():
        n = len(words(text))
        if out and size + n > block_words:
            yield out
            out, size = [], 0
        if n:
            out.append((item, text))
            size += n
    yield out


def match_spans(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, then=None, schema=None) -> DataFrame:
    """``docs`` with ``__cachelens_span`` (flat list of hit word ranges, from and to) and ``__cachelens_item`` (ids of
    items with occurring windows). ``then`` works on the result's batches in the same pass as the last block and gives
    ``schema``."""
    chosen = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null").orderBy("i", "t")
    out = docs.withColumns({"__cachelens_span": F.array().cast("array<int>"), "__cachelens_item": F.array().cast("array<string>")})
    blocks, last = _blocks(chosen, block_words), None
    for block in blocks:
        if last is not None:
            before, out = out, written(out.mapInArrow(released(_matcher(last, window, text_col)), out.schema), "matched")
            forget(before)
        last = block
    matcher = _matcher(last, window, text_col)
    if then is None:
        return out.mapInArrow(released(matcher), out.schema)
    return out.mapInArrow(released(lambda batches: then(matcher(batches))), schema)


def _strip(limit_words: int, limit_share: float, text_at: str):
    """Removes hit spans from texts: what stands between the kept words stays."""
    import re

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, keep = [], []
            for text, flat in zip(batch.column(text_at).to_pylist(), batch.column("__cachelens_span").to_pylist()):
                spans = list(zip(flat[::2], flat[1::2]))
                if spans:
                    raw = text.encode()
                    at = [m.span() for m in word.finditer(raw.lower())]
                    hit = sum(b - a for a, b in spans)
                    if hit > limit_words or hit > limit_share * len(at):
                        keep.append(False)
                        texts.append(text)
                        continue
                    for a, b in reversed(spans):
                        raw = raw[: at[a][0]] + raw[at[b - 1][1] :]
                    text = raw.decode()
                texts.append(text)
                keep.append(True)
            columns = [pa.array(texts, pa.string()) if n == text_at else batch.column(n) for n in names if n not in ("__cachelens_span", "__cachelens_item")]
            out = pa.RecordBatch.from_arrays(columns, [n for n in names if n not in ("__cachelens_span", "__cachelens_item")])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, limit_words: int = 200, limit_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without leaked spans: hit words are cut out; a document with over ``limit_words`` of them, or over
    ``limit_share`` of its words, goes. Other columns pass unchanged."""
    return match_spans(docs, items, window, text_col, then=_strip(limit_words, limit_share, text_col), schema=docs.schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words = [len(words(t)) for t in batch.column("text").to_pylist()]
        spans, items = batch.column("__cachelens_span").to_pylist(), batch.column("__cachelens_item").to_pylist()
        hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        digest = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit])],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return match_spans(docs.select("doc_id", "text"), items, window, then=_digest, schema=schema)
