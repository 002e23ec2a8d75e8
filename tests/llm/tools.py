"""The leakage search over lists, without a session."""

from collections import Counter

import numpy as np

from spanloom.llm import leakage
from spanloom.llm.plain import plain, word_hashes


def leaks(items, texts, size=leakage.SKETCH):
    """(text index, item id, share) of every candidate of a few items (id, text)."""
    words = {i: word_hashes([plain(t)])[0] for i, t in items}
    times = Counter(x for w in {w.tobytes(): w for w in words.values()}.values() for x in set(leakage._shingles(w).tolist()))
    kept = {i: w for i, w in words.items() if len(w) > leakage.SHINGLE}
    shared = {i: np.array([times[x] > 1 for x in leakage._shingles(w).tolist()]) for i, w in kept.items()}
    profiles = {i: leakage.profile(w, shared[i]) for i, w in kept.items()}
    sketches = [leakage.sketch(leakage._shingles(kept[i])[~shared[i]] if not shared[i].all() else leakage._shingles(kept[i]), size) for i in kept] if size != leakage.SKETCH else [p[1] for p in profiles.values()]
    ids = list(kept)
    known = leakage.Sketches.of(np.arange(len(ids)), np.array([len(kept[i]) for i in ids], np.int64), sketches)
    for d, k, at, x in leakage.candidates(known, texts):
        yield d, ids[k], leakage.verified(at, x, leakage._shingles(kept[ids[k]]), profiles[ids[k]][0])
