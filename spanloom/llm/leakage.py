"""Evaluation texts that leaked into a corpus: size-partitioned MinHash containment search, verified by exact shingles.

An item is short and a document long, so the similarity of their sets says nothing; what counts is how much of the item
the document contains. The search goes in three steps, each a plan over DataFrames.

1. Items become profiles: their shingles in order, and a MinHash sketch. Items are partitioned by size (the number of their
   shingles, four partitions an octave); a partition's sketches are the hashes under a threshold of its own, so that a
   sketch has about ``SKETCH`` hashes however long its item is. Set phrases, which different items share, are found once
   over all items and left out of the sketches.
2. Documents are read once per ``HASHES_PER_PASS`` sketch hashes. A document's hashes under a partition's threshold are its
   sketch there, so hits over the size of the item's sketch estimate the containment. Pairs of an estimate of
   ``CANDIDATE`` or more are candidates; they carry the document's shingles around the hits.
3. Candidates meet the items' whole profiles by a join. A passage is verified by its shingles, which must follow the item's
   order nearly unbroken in one stretch or two.

Each pair is judged by itself, so the number of passes has no influence on the result. Shingles have three words, not
five, because single words of a passage may differ: at one changed word in ten, five-word shingles lose two fifths of the
evidence, and the least passage of a short item is some 14 words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.common import cut
from spanloom.llm.plain import plain, word_hashes

SHINGLE = 3
#: Hashes of a sketch, about; items with no more shingles keep all.
SKETCH = 40
#: Least share of a sketch's hashes among the document's, and the least number of them. A verified case holds at least
#: (0.36 n - 4) / 3 of an item's n shingles, see ``covered``, so nothing is lost where a sketch keeps all.
CANDIDATE, HITS = 0.08, 2
#: Words of the item, as a share, that the verified stretches must span. Changed words at the passage's rims cannot be
#: seen by shingles, so it is a little under two fifths.
LEAST = 0.36
#: Most words that may be missing or foreign between two shingles of a stretch, and most drift between the two orders.
BREAK, DRIFT = 9, 4
#: A second stretch counts from this many words on.
SECOND = 6
#: Set phrases are runs of at least that many words that different items share. Of the item's other words, as a share,
#: the stretches must span that much, so that a phrase alone is no case.
PHRASE, OWN = 5, 0.2
#: Sketch hashes broadcast at a time (16 bytes each); more take more passes over the documents.
HASHES_PER_PASS = 4_000_000


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + (c ^ (c >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def _shingles(w: np.ndarray) -> np.ndarray:
    """Hash of each run of three words (by the hashes of its words)."""
    return _mixed(w[:-2], w[1:-1], w[2:]) if len(w) >= SHINGLE else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The MinHash sketch of a set of hashes: those under the threshold of the set's size partition."""
    distinct = np.unique(hashes)
    n = len(distinct)
    if n <= size:
        return distinct
    rate = 2.0 ** (-math.floor(4 * math.log2(n / size)) / 4)
    kept = int(np.searchsorted(distinct, np.uint64(min(rate * 2.0**64, 2.0**64 - 2048))))
    return distinct[: max(kept, size // 2)]


def _own_words(shared: np.ndarray, n: int) -> np.ndarray:
    """Running count of an item's words outside of set phrases; of all words if phrases make up most of it."""
    phrase = np.zeros(n, bool)
    edge = np.flatnonzero(np.diff(np.r_[0, shared.astype(np.int8), 0]))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a + SHINGLE - 1 >= PHRASE:
            phrase[a : b + SHINGLE - 1] = True
    own = ~phrase if phrase.sum() * 2 <= n else np.ones(n, bool)
    return np.r_[0, np.cumsum(own)]


def _stretches(at: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (first place, last place, shingles) of hits, in document order, that follow the item's order."""
    open_, closed = [], []
    for d, p in zip(at.tolist(), place.tolist()):
        best = None
        for s in open_:
            dd, dp = d - s[0], p - s[2]
            if 0 < dp <= BREAK + SHINGLE and 0 < dd <= BREAK + SHINGLE and abs(dd - dp) <= DRIFT and (best is None or s[3] > best[3]):
                best = s
        if best is not None:
            best[0], best[2], best[3] = d, p, best[3] + 1
        else:
            open_.append([d, p, p, 1])
        if len(open_) > 32:
            closed += [s for s in open_ if d - s[0] > BREAK + SHINGLE]
            open_ = [s for s in open_ if d - s[0] <= BREAK + SHINGLE]
    return [(s[1], s[2], s[3]) for s in closed + open_]


def covered(at: np.ndarray, place: np.ndarray, own: np.ndarray) -> int:
    """Words of the item spanned by the best one or two stretches that don't share words and aren't mere set phrases."""
    runs = [(a, b + SHINGLE, n) for a, b, n in _stretches(at, place) if n > 1]
    runs = [r for r in runs if r[2] * 3 >= r[1] - r[0] - 2]  # nearly unbroken: a changed word hides three shingles
    runs = [(a, b, int(own[b] - own[a])) for a, b, _ in runs]
    least, best = OWN * own[-1], 0
    for i, (a, b, m) in enumerate(runs):
        if m >= least:
            best = max(best, b - a)
        for c, d, k in runs[:i]:
            if m + k >= least and min(b - a, d - c) >= SECOND and (c >= b - 2 or a >= d - 2):
                best = max(best, b - a + d - c)
    return best


def profile(words: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running count of the item's own words, sketch of its own shingles); ``shared`` marks the shingles other items have."""
    own, s = _own_words(shared, len(words)), _shingles(words)
    mostly = own[-1] < len(words) or not shared.any()
    return own, sketch(s[~shared] if mostly and not shared.all() else s)


@dataclass
class Sketches:
    """The sketches of one pass: hashes in order with the item text each belongs to, and what a text's pair needs."""

    hashes: np.ndarray
    text: np.ndarray
    keys: np.ndarray
    n_words: np.ndarray
    need: np.ndarray
    maybe: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, n_words: np.ndarray, sketches: list[np.ndarray]) -> Sketches:
        size = np.array([len(s) for s in sketches], np.int64)
        h = np.concatenate([np.zeros(0, np.uint64), *sketches])
        order = np.argsort(h, kind="stable")
        maybe = np.zeros(1 << max(16, int(len(h)).bit_length() + 4), bool)
        maybe[h & np.uint64(len(maybe) - 1)] = True
        need = np.maximum(HITS, np.ceil(CANDIDATE * size - 1e-9)).astype(np.int64)
        return cls(h[order], np.repeat(np.arange(len(keys)), size)[order], keys, n_words, need, maybe)


def candidates(known: Sketches, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(index of the text, index of the item text, places, shingles there) of every pair whose sketches say it may be a case."""
    words, owner = word_hashes([plain(t) for t in texts])
    if len(words) < SHINGLE or not len(known.hashes):
        return
    x = _shingles(words)
    at = np.flatnonzero(known.maybe[x & np.uint64(len(known.maybe) - 1)] & (owner[:-2] == owner[2:]))
    lo, hi = np.searchsorted(known.hashes, x[at]), np.searchsorted(known.hashes, x[at], "right")
    n = hi - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    if not len(at):
        return
    text = known.text[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    at = np.repeat(at, n)
    pair = owner[at].astype(np.int64) * len(known.keys) + text
    order = np.lexsort((x[at], pair))
    first = np.r_[True, (pair[order][1:] != pair[order][:-1]) | (x[at][order][1:] != x[at][order][:-1])]
    distinct, hits = np.unique(pair[order][first], return_counts=True)
    enough = distinct[hits >= known.need[distinct % len(known.keys)]]
    ends = np.searchsorted(owner, np.arange(len(texts)), "right") - (SHINGLE - 1)
    begins = np.searchsorted(owner, np.arange(len(texts)))
    order = np.lexsort((at, pair))
    pair, at = pair[order], at[order]
    for p in enough.tolist():
        d, k = divmod(p, len(known.keys))
        mine = at[np.searchsorted(pair, p) : np.searchsorted(pair, p, "right")]
        # a passage lies around its hits, no further than the item is long
        reach = int(known.n_words[k] * 1.25) + 2 * BREAK
        near = np.zeros(ends[d] - begins[d] + 1, np.int32)
        np.add.at(near, np.maximum(mine - reach, begins[d]) - begins[d], 1)
        np.add.at(near, np.minimum(mine + reach + 1, ends[d]) - begins[d], -1)
        places = np.flatnonzero(np.cumsum(near)[:-1] > 0) + begins[d]
        yield d, k, places - begins[d], x[places]


def verified(at: np.ndarray, hashes: np.ndarray, shingles: np.ndarray, own: np.ndarray) -> float:
    """Share of the item's words that the best passage spans, by exact containment of its shingles in order."""
    order = np.argsort(shingles, kind="stable")
    lo, hi = np.searchsorted(shingles[order], hashes), np.searchsorted(shingles[order], hashes, "right")
    n = hi - lo
    where = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return covered(np.repeat(at, n), order[where], own) / max(1, len(shingles) + SHINGLE - 1)


def _profiled(items: DataFrame) -> DataFrame:
    """item_id, text_key, n_words, shingles of each item with at least two shingles; equal word sequences have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, t in zip(b.column(0), b.column(1).to_pylist()):
                words, _ = word_hashes([plain(t)])
                if len(words) > SHINGLE:
                    key = int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)
                    for column, x in zip(out, (i.as_py(), key, len(words), words.view(np.int64))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int64()))], ["item_id", "text_key", "n_words", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, text_key long, n_words int, words array<long>")


def _sketched(texts: DataFrame) -> DataFrame:
    """text_key, n_words, words, own, sketch of item texts (text_key, n_words, words)."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [_shingles(np.array(w, np.int64).view(np.uint64)).view(np.int64) for w in b.column(1).to_pylist()]
            n = [len(x) for x in s]
            at = pa.array(np.repeat(np.arange(len(s)), n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.concatenate([np.arange(k) for k in n] or [[]]), pa.int32()), pa.array(np.concatenate(s or [[]]), pa.int64())], ["text_key", "place", "shingle"])

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, sk = [], []
            for w, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = np.array(w, np.int64).view(np.uint64)
                shared = np.zeros(len(words) - SHINGLE + 1, bool)
                shared[places or []] = True
                o, s = profile(words, shared)
                own.append(o.astype(np.int32)), sk.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.list_(pa.int32())), pa.array(sk, pa.list_(pa.int64()))], ["text_key", "n_words", "words", "own", "sketch"])

    rows = texts.select("text_key", "words").mapInArrow(exploded, "text_key long, place int, shingle long")
    phrases = rows.groupBy("shingle").agg((F.min("text_key") < F.max("text_key")).alias("many")).where("many").select("shingle")
    shared = rows.join(phrases, "shingle").groupBy("text_key").agg(F.collect_list("place").alias("shared"))
    joined = texts.join(shared, "text_key", "left").select("text_key", "n_words", "words", "shared")
    return joined.mapInArrow(profiles, "text_key long, n_words int, words array<long>, own array<int>, sketch array<long>")


def _candidates(docs: DataFrame, known: Sketches, chars_per_batch: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        its = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            row, key, places, hashes, lo, size = [], [], [], [], 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t) if t else 0
                if size >= chars_per_batch or hi == len(texts):
                    for d, k, at, x in candidates(its, [t or "" for t in texts[lo:hi]]):
                        row.append(lo + d), key.append(int(its.keys[k])), places.append(at.astype(np.int32)), hashes.append(x.view(np.int64))
                    lo, size = hi, 0
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(key, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "text_key", "places", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_key long, places array<int>, hashes array<long>")


def _verify(pairs: DataFrame, least: float) -> DataFrame:
    """doc_id, text_key, share of the pairs (doc_id, text_key, places, hashes, words, own) that hold a passage."""
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(i).flatten().to_numpy() for i in range(2, 6)]
            ends = [np.cumsum([0, *pa.compute.list_value_length(b.column(i)).to_pylist()]) for i in range(2, 6)]
            row, share = [], []
            for r in range(b.num_rows):
                at, x, words, own = (c[e[r] : e[r + 1]] for c, e in zip(columns, ends))
                got = verified(at, x.view(np.uint64), _shingles(words.view(np.uint64)), own)
                if got >= least:
                    row.append(r), share.append(got)
            kept = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept), pa.array(share, pa.float64())], ["doc_id", "text_key", "share"])

    return pairs.select("doc_id", "text_key", "places", "hashes", "words", "own").mapInArrow(run, f"doc_id {kind}, text_key long, share double")


def find_leaks(docs: DataFrame, items: DataFrame, least: float = LEAST, chars_per_batch: int = 2_000_000, hashes_per_pass: int = HASHES_PER_PASS) -> DataFrame:
    """doc_id, item_id and the share of the item's words spanned, of every document that carries a passage of an item.

    Null and empty texts, and items under four words (a short quote is no case), match nothing. Items with equal words are
    each reported; repeated document rows give repeated result rows. Empty tables give an empty result. What is broadcast
    holds at most ``hashes_per_pass`` sketch hashes; more items take more passes over the documents, with the same result.
    """
    listed = cut(_profiled(items.where(F.length("text") > 0)))
    texts = listed.groupBy("text_key").agg(F.first("n_words").alias("n_words"), F.first("words").alias("words"))
    profiles = cut(_sketched(texts))
    total = profiles.agg(F.sum(F.size("sketch"))).first()[0] or 0
    passes = max(1, -(-total // hashes_per_pass))
    pairs = None
    for k in range(passes):
        part = profiles.where(F.pmod(F.xxhash64("text_key"), F.lit(passes)) == k) if passes > 1 else profiles
        rows = part.select("text_key", "n_words", "sketch").toArrow()
        sketches = [np.array(s, np.int64).view(np.uint64) for s in rows["sketch"].to_pylist()]
        found = _candidates(docs, Sketches.of(rows["text_key"].to_numpy(), rows["n_words"].to_numpy(), sketches), chars_per_batch)
        pairs = found if pairs is None else pairs.union(found)
    cases = _verify(pairs.join(profiles.select("text_key", "words", "own"), "text_key"), least)
    return cases.join(listed.select("text_key", "item_id"), "text_key").select("doc_id", "item_id", "share")
