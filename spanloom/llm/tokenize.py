"""Encoding a whole corpus with a public byte-level BPE vocabulary.

A batch of texts is one flat array. Words are cut where the character class changes (the vocabulary's pattern written as
array conditions), hashed, and looked up among the words the worker has met. Words not met before are encoded together:
their symbols stand in one flat array, each round looks up adjacent pairs by binary search over the sorted pair keys and
merges, in each word, the pairs of the word's lowest rank. Documents are put together by one ragged gather, so no Python
loop runs over characters, words or tokens.

The vocabulary file is a parameter (``path``) and is read by each worker; it is never shipped with the plan.
"""

from __future__ import annotations

import base64
import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

#: Fixed value: the pattern of byte-level BPE vocabularies of this family, which ``cut`` follows.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words kept by a worker before its memory of words is emptied (they are encoded anew when met again).
REMEMBERED = 2_000_000
OTHER, LETTER, NUMBER, SPACE = range(4)
NONE = np.int64(1) << 40
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def char_classes() -> np.ndarray:
    """The pattern's class of every code point."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, sys.maxunicode + 1)))
    out = np.zeros(len(every), np.uint8)
    for k, x in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(x, every):
            out[m.start() : m.end()] = k
    return out


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    """The vocabulary of a worker process, with the words it has met: read once, not for each task."""
    return ByteBpe(path)


class ByteBpe:
    """A rank vocabulary (token bytes and rank per line) as sorted merge tables, with the words met so far."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_id = np.full(256, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.byte_id[token[0]] = rank
        keys, into = [], []
        for token, rank in ranks.items():
            # any split into two tokens is a possible merge, so a pair's rank is that of its concatenation
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    into.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs, self.into = np.array(keys, np.int64)[order], np.array(into, np.int64)[order]
        self.classes = char_classes()
        self.forget()

    def forget(self) -> None:
        self.hashes, self.checks, self.word_of = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.offset, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def cut(self, data: np.ndarray, text_at: np.ndarray) -> np.ndarray:
        """Byte offsets at which the words of the UTF-8 ``data`` begin; ``text_at``: where its texts begin."""
        if len(data) == 0:
            return np.zeros(0, np.int64)
        ascii_only = data.max() < 128
        if ascii_only:
            chars, lead = data, None
        else:
            chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            lead = np.flatnonzero((data & 0xC0) != 0x80)
        kind = self.classes[chars]
        n = len(kind)
        first = np.zeros(n, bool)
        text_at = text_at[text_at < len(data)]
        first[text_at if ascii_only else np.searchsorted(lead, text_at)] = True
        space = kind == SPACE
        begin = first.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        # a space run gives its last character to what follows: joined to it if it is a blank, else alone
        ends = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
        begin[ends] = True
        begin[ends + 1] = chars[ends] != 32
        # 's 'd 'm 't 'll 've 're at a word's begin are words
        q = np.flatnonzero((chars == 39) & begin)
        q = q[q + 1 < n]
        q = q[~first[q + 1]]
        nxt = chars[q + 1]
        two = (nxt == 115) | (nxt == 100) | (nxt == 109) | (nxt == 116)
        third = chars[np.minimum(q + 2, n - 1)]
        three = ~two & (q + 2 < n) & ~first[np.minimum(q + 2, n - 1)] & (((nxt == 108) & (third == 108)) | (((nxt == 118) | (nxt == 114)) & (third == 101)))
        for which, size in ((two, 2), (three, 3)):
            at = q[which]
            begin[at + 1] = False
            stop = at + size
            begin[stop[stop < n]] = True
        at = np.flatnonzero(begin)
        return at if ascii_only else lead[at]

    @staticmethod
    def hash(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        a, b = _mix(size.astype(np.uint64), 0x9E3779B97F4A7C15), _mix(size.astype(np.uint64), 0xC2B2AE3D27D4EB4F)
        on, k = np.arange(len(start)), 0
        while len(on):
            x = eight[start[on] + k] & MASKS[np.minimum(size[on] - k, 8)]
            if k == 0:
                a, b = _mix(a ^ x, 0xFF51AFD7ED558CCD), _mix(b + x, 0xC4CEB9FE1A85EC53)
            else:
                a[on], b[on] = _mix(a[on] ^ x, 0xFF51AFD7ED558CCD), _mix(b[on] + x, 0xC4CEB9FE1A85EC53)
            k += 8
            on = on[size[on] > k]
        return a, b

    def _rank(self, key: np.ndarray, same: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[i] == key) & same, self.into[i], NONE)

    def merge(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of words that stand one after the other in ``data``."""
        n = len(size)
        sym, word, at = self.byte_id[data], np.repeat(np.arange(n), size), np.arange(len(data))
        done_sym, done_word, done_at = [], [], []
        rank = np.append(self._rank(sym[:-1] << 32 | sym[1:], word[:-1] == word[1:]), NONE) if len(sym) else NONE
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            mine = np.repeat(low, np.diff(np.r_[starts, len(word)]))
            hit = (rank == mine) & (rank < NONE)
            # of a run of overlapping hits (aaa) every second one counts, from the left
            follows = np.r_[False, hit[:-1]]
            if (hit & follows).any():
                pos = np.arange(len(hit))
                since = pos - np.maximum.accumulate(np.where(hit & ~follows, pos, 0))
                hit &= since % 2 == 0
                follows = np.r_[False, hit[:-1]]
            sym = np.where(hit, rank, sym)
            over = ~follows & (mine == NONE)
            done_sym.append(sym[over]), done_word.append(word[over]), done_at.append(at[over])
            live = ~follows & ~over
            new = hit[live]
            sym, word, at, rank = sym[live], word[live], at[live], rank[live]
            if len(sym):
                # only pairs with a merged symbol have another rank now
                touched = np.flatnonzero((new | np.r_[new[1:], False])[:-1])
                rank[touched] = self._rank(sym[touched] << 32 | sym[touched + 1], word[touched] == word[touched + 1])
                rank[-1] = NONE
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        sym, at = np.concatenate(done_sym), np.concatenate(done_at)
        return sym[np.argsort(at)].astype(np.int32), np.bincount(np.concatenate(done_word), minlength=n)

    def _gathered(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]

    def encode(self, data: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, list offsets) of the texts of the UTF-8 ``data``; ``text_at``: their offsets and the end's."""
        if len(self.offset) > REMEMBERED:
            self.forget()
        start = self.cut(data, text_at[:-1])
        size = np.diff(np.append(start, len(data)))
        h, check = self.hash(data, start, size)
        if len(h) == 0:
            return np.zeros(0, np.int32), np.zeros(len(text_at), np.int64)
        order = np.argsort(h)
        run = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        one = order[run]  # a place of each distinct word
        at = np.minimum(np.searchsorted(self.hashes, h[one]), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h[one] if len(self.hashes) else np.zeros(len(one), bool)
        new = one[~known]
        if len(new):
            flat, counts = self.merge(self._gathered(data, start[new], size[new]), size[new])
            base = len(self.offset)
            self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(counts) - counts])
            self.length, self.flat = np.concatenate([self.length, counts]), np.concatenate([self.flat, flat])
            place = np.searchsorted(self.hashes, h[new])
            self.hashes = np.insert(self.hashes, place, h[new])
            self.checks = np.insert(self.checks, place, check[new])
            self.word_of = np.insert(self.word_of, place, np.arange(base, base + len(new)))
            at = np.searchsorted(self.hashes, h[one])
        w = np.empty(len(h), np.int64)
        w[order] = np.repeat(self.word_of[at], np.diff(np.append(run, len(h))))
        okay = np.empty(len(h), bool)
        okay[order] = np.repeat(self.checks[at], np.diff(np.append(run, len(h)))) == check[order]
        if not okay.all():  # two words of one hash: the second is encoded each time
            odd = np.flatnonzero(~okay)
            flat, counts = self.merge(self._gathered(data, start[odd], size[odd]), size[odd])
            w[odd] = np.arange(len(self.offset), len(self.offset) + len(odd))
            offset, length = np.concatenate([self.offset, len(self.flat) + np.cumsum(counts) - counts]), np.concatenate([self.length, counts])
            source = np.concatenate([self.flat, flat])
        else:
            offset, length, source = self.offset, self.length, self.flat
        size_of = length[w]
        ends = np.cumsum(size_of)
        place = np.repeat(offset[w] - (ends - size_of), size_of) + np.arange(int(ends[-1]))
        return source[place], np.append(0, ends)[np.searchsorted(start, text_at)]


def encode_texts(bpe: ByteBpe, texts: pa.Array) -> pa.ListArray:
    """The ids of each text of a string array; null and empty texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, where, raw = texts.buffers()
    at = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    flat, ends = bpe.encode(data, at - at[0])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode_corpus(df: DataFrame, path: str | None = None, bytes_per_batch: int = 4_000_000) -> DataFrame:
    """doc_id and ids (array<int>, no special tokens) of every row of ``df``.

    Null and empty texts give an empty list; strings of special tokens are ordinary text. Repeated rows are each
    encoded, whole texts always; one row per input row, no shuffle. Batches are cut by bytes, so very long texts bound
    memory by their own size only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path or default_path())
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            size = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64))
            lo = 0
            while lo < len(ids):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + bytes_per_batch, "right")))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), encode_texts(bpe, texts.slice(lo, hi - lo))], ["doc_id", "ids"])
                lo = hi

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
