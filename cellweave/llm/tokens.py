"""Token ids of a public byte-level BPE vocabulary, by replaying its merges over a corpus.

A task's different words are laid out as one sequence of symbols. An inverted index holds, for each merge,
the places of its pair; merges are applied in rank order, each at all of its places at once, and only the
neighbours of a merged place enter the index anew. A merge can only create pairs of later ranks, so one pass
over the ranks gives what merging each word by itself gives.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellweave.plans import spread

#: Folder of the public vocabularies, and the pattern that splits text before the merges (fixed values).
TOKENIZERS = "/opt/tokenizers"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Different words whose ids a task keeps, and characters that a task replays at a time.
KEPT_WORDS, REPLAYED = 1 << 19, 1 << 21


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, which are their ranks, of a rank file."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class MergeReplay:
    """Encodes words by replaying merges over all of them together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = [ranks[bytes([b])] for b in range(256)]
        token = {i: t for t, i in ranks.items()}
        self.merge: dict[int, int] = {}  # left id << 32 | right id -> id of both
        for whole, i in ranks.items():
            for cut in range(1, len(whole)):
                left, right = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                # A merge joins tokens that exist before it.
                if left is not None and right is not None and max(left if len(token[left]) > 1 else -1, right if len(token[right]) > 1 else -1) < i:
                    self.merge[left << 32 | right] = i

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        merge, byte = self.merge, self.byte
        # One symbol a byte; -1 parts the words.
        sym: list[int] = []
        for w in words:
            sym.extend([byte[b] for b in w])
            sym.append(-1)
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            a, b = sym[i], sym[i + 1]
            if a >= 0 and b >= 0:
                r = merge.get(a << 32 | b)
                if r is not None:
                    places.setdefault(r, []).append(i)
        heap = list(places)
        heapq.heapify(heap)
        get = merge.get
        while heap:
            r = heapq.heappop(heap)
            at = places.pop(r)
            at.sort()
            for i in at:
                a = sym[i]
                if a < 0:
                    continue
                j = after[i]
                if j >= n or sym[j] < 0 or get(a << 32 | sym[j]) != r:
                    continue
                sym[i], sym[j] = r, -2  # merged away
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    c = sym[k]
                    if c >= 0 and (m := get(r << 32 | c)) is not None:
                        if m in places:
                            places[m].append(i)
                        else:
                            places[m] = [i]
                            heapq.heappush(heap, m)
                h = before[i]
                if h >= 0 and sym[h] >= 0 and (m := get(sym[h] << 32 | r)) is not None:
                    if m in places:
                        places[m].append(h)
                    else:
                        places[m] = [h]
                        heapq.heappush(heap, m)
        out, word = [], []
        for s in sym:
            if s >= 0:
                word.append(s)
            elif s == -1:
                out.append(word)
                word = []
        return out


class _Task:
    """The words that a task has met, as ranges of one array of ids."""

    def __init__(self, replay: MergeReplay):
        import regex

        self.replay, self.split = replay, regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.start, self.size, self.ids, self.end = [], [], [], 0

    def _learn(self, new: list[str]) -> None:
        held, chars = [], 0
        for k, w in enumerate(new):
            held.append(w.encode())
            chars += len(w)
            if chars >= REPLAYED or k == len(new) - 1:
                for ids in self.replay.encode(held):
                    self.start.append(self.end)
                    self.size.append(len(ids))
                    self.ids.append(ids)
                    self.end += len(ids)
                held, chars = [], 0

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        if len(self.code) > KEPT_WORDS:
            self.forget()
        code, met, n_words, new = self.code, [], [], []
        for t in texts:
            words = self.split(t) if t else []
            n_words.append(len(words))
            for w in words:
                c = code.get(w)
                if c is None:
                    c = code[w] = len(code)
                    new.append(w)
                met.append(c)
        self._learn(new)
        self.ids = [np.concatenate([np.asarray(x, np.int32) for x in self.ids])] if self.ids else []
        flat = self.ids[0] if self.ids else np.zeros(0, np.int32)
        words = np.array(met, np.int64)
        start, size = np.array(self.start, np.int64)[words], np.array(self.size, np.int64)[words]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(start, size)
        ends = np.concatenate([[0], np.cumsum(size)])
        last = np.cumsum(np.array(n_words, np.int64))
        counts = np.diff(np.concatenate([[0], ends[last]])) if len(last) else last
        return flat[at], counts


def _encoder(ranks, text: str, counts_only: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(MergeReplay(ranks.value))
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                ids, counts = task.encode(part.column(text).to_pylist())
                if counts_only:
                    made = pa.array(counts.astype(np.int64))
                else:
                    made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                rest = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], names=[*rest, "n_tokens" if counts_only else "ids"])

    return run


def encode_corpus(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, counts_only: bool = False) -> DataFrame:
    """``keep`` and ids (array of int) of each row's text, without special tokens; with ``counts_only``
    n_tokens (bigint) in their place. One row for each row of docs.

    Null and empty texts have no tokens: ids is an empty list, n_tokens 0. Strings of special tokens in a
    text are ordinary text. Texts are encoded whole, whatever their length. Texts are encoded where they are
    read; only an input of fewer splits than cores is spread first. The vocabulary, of fixed size, is
    read on the driver from ``folder``/``vocabulary``.tiktoken and broadcast.
    """
    if {"ids", "n_tokens", text} & set(keep):
        raise ValueError("keep holds the text or a column of the result")
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(f"{folder}/{vocabulary}.tiktoken"))
    rows = spread(docs.select(*keep, text), *keep)
    made = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_encoder(ranks, text, counts_only), T.StructType([*(rows.schema[c] for c in keep), made]))
