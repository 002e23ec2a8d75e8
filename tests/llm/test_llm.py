"""Training-text operators against brute force, an exact library and planted cases."""

import random

import pytest

pytest.importorskip("spanloom.llm")

from spanloom.llm import cells, leakage, plain, split, stuffing, tokenize  # noqa: E402


# --- splitting


def brute_pieces(s, e, breaks, limit=100_000, least=50_000, overlap=2_000):
    out, no = [], 1
    while True:
        near = [b for b in breaks if s + least < b <= s + limit]
        stop = e if e - s <= limit else max(near, default=s + limit)
        out.append((no, s, stop))
        if stop == e:
            return out
        s, no = stop - overlap, no + 1


def test_regions_against_brute_force(spark):
    rnd = random.Random(3)
    marks = [(c, rnd.randrange(0, 3_000_000)) for c in ("chr1", " chr2") for _ in range(60)] + [("chr1", None), (None, 5)]
    marks += marks[:20]
    regions = []
    for i in range(60):
        s = rnd.randrange(-200_000, 2_000_000)
        regions.append((i, rnd.choice(["chr1 ", "chr2", "chr3", None]), s, s + rnd.choice([-5, 0, 100_000, 100_001, 250_000, 1_500_000, 3_100_000]), "x"))
    regions += [(90, "chr1", None, 5, "x"), (91, "chr1", 5, None, "x")] + [regions[0], regions[0]]
    by = {}
    for c, p in marks:
        if c and p is not None:
            by.setdefault(c.strip(), []).append(p)
    want = []
    for i, c, s, e, _ in regions:
        if c and s is not None and e is not None and e - s > 100_000:
            want += [(i, *p) for p in brute_pieces(s, e, by.get(c.strip(), []))]
    r = spark.createDataFrame(regions, "region_id long, chrom string, start long, end long, breaks string")
    b = spark.createDataFrame(marks, "chrom string, pos long")
    assert sorted(map(tuple, split.split_regions(r, b).collect())) == sorted(want)
    assert split.split_regions(r.limit(0), b).collect() == []
    assert len(split.split_regions(r, b.limit(0)).collect()) > 0


def test_texts_round_trip_within_the_limit(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab .!?\n\n😀é") for _ in range(rnd.choice([1, 5, 99, 100, 101, 500, 5000]))) for _ in range(40)] + [None, "", "x" * 30_000, "one two. " * 400]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, i int")
    got = {}
    for r in split.split_texts(df, 100, 10).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        if not t:
            assert i not in got
            continue
        joined = ""
        for n, r in enumerate(got[i], 1):
            assert r.piece_no == n and 0 < len(r.piece) <= 100
            assert t[r.piece_start : r.piece_start + len(r.piece)] == r.piece
            assert n == 1 or r.piece_start == len(joined) - 10
            joined += r.piece[10 if n > 1 else 0 :]
        assert joined == t
    # natural boundaries are taken where they are in reach
    assert all(r.piece.endswith(". ") for r in got[len(texts) - 1][:-1])
    with pytest.raises(ValueError):
        split.split_texts(df, 10, 5)


# --- encoding

TRICKY = ["", None, "   ", "a\x1cb \x1f\x85x", "<|endoftext|> hi", "aaaaaaaaaaaaaaa" * 50, " \n\n  \t x", "\u3000\u3000a", "１２３ ½ x²", "it's IT'S we'll", "\ufeffa\u200bb", "'s's'll", "''s 's \n's '", "'", "'r", "'l", "s", " ", "x '", "日本語のテキスト、です。", "naïve 😀😀 café", "\x00a\x00"]


def exact(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_are_those_of_the_library(spark):
    pytest.importorskip("public_tokenizers")
    rnd = random.Random(0)
    texts = TRICKY + ["".join(rnd.choice(["the ", "ing", "'ll", " 'd", "  ", "\n", "9", "é", "汉", "_", "== ", "Zq", "\t"]) for _ in range(rnd.randrange(60))) for _ in range(400)]
    got = [None] * len(texts)
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    for r in tokenize.encode_corpus(df, bytes_per_batch=500).collect():
        got[r.doc_id] = r.ids
    assert got == exact(texts)
    assert tokenize.encode_corpus(df.limit(0)).collect() == []


def test_words_forgotten_and_clashing_hashes_change_nothing(monkeypatch):
    pytest.importorskip("public_tokenizers")
    import numpy as np
    import pyarrow as pa

    bpe = tokenize.ByteBpe(tokenize.default_path())
    monkeypatch.setattr(tokenize, "REMEMBERED", 10)
    texts = ["some words here", "and other words there", "some words again and again"] * 3
    for _ in range(2):
        assert tokenize.encode_texts(bpe, pa.array(texts)).to_pylist() == exact(texts)
    real = bpe.hash

    def poor(data, start, size):
        a, b = real(data, start, size)
        return a % np.uint64(3), b

    bpe.forget()
    monkeypatch.setattr(bpe, "hash", poor)
    assert tokenize.encode_texts(bpe, pa.array(texts)).to_pylist() == exact(texts)


# --- leakage

ITEMS = [
    (1, "Opposite the quarry Quilulaa dried 912 rusted pegs, and some clerk sketched 15 salt keys in secret. Another pilot of Narotson buried 152 carved nettle lanterns near the fountain after the royal fair."),
    (2, "Vor dem Ofen ordnete Quilero 327 blaue Laternen und mit großer Sorgfalt noch 53 Säcke. Seit dem siebten Schnitt stapelte ein Fährmann 603 namenlose Kämme aus Messing gegenüber dem Brunnen."),
    (3, "def lomander_nararra(lomula, orbeth):\n    while lomula < orbeth // 91: orbine += 1\n    if zorax > hestix - 9: return 'meveth'\n    hestix = korix * 266 + len('fexix')\n    return lomula"),
    (4, None),
    (5, ""),
    (6, "ab"),
]
FILLER = "The second orchard of our loop never halves the output whenever it rains. " * 30


def forms(t):
    w = t.split()
    half = len(w) // 2
    yield t
    yield t.upper()
    yield t.replace("e", "e\u00ad").replace("o", "\u043e")
    yield " ".join(f"<b>{x}</b>" if i % 4 == 0 and "<" not in t else x for i, x in enumerate(w))
    yield t.replace('"', '\\"').replace("\n", "\\n")
    yield "\n".join("# " + " ".join(w[i : i + 7]) for i in range(0, len(w), 7))
    yield " ".join(w[half:])
    yield " ".join(w[: len(w) // 4 + 1]) + "\n\n" + FILLER + "\n\n" + " ".join(w[-len(w) // 4 - 2 :])
    yield " ".join("very" if i % 11 == 5 else x for i, x in enumerate(w))


def no_case(t):
    w = t.split()
    yield " ".join(w[:5])
    yield " ".join(sorted(w))
    yield " ".join(w[::-1])
    yield FILLER


def test_planted_passages_are_found_and_others_not(spark):
    docs, want = [], set()
    for k, t in ITEMS[:3]:
        for f in forms(t):
            want.add((len(docs), k))
            docs.append((len(docs), FILLER + "\n" + f + "\n" + FILLER, 0.5))
        for f in no_case(t):
            docs.append((len(docs), FILLER + "\n" + f + "\n" + FILLER, 0.5))
    docs += [(len(docs), None, 0.5), (len(docs) + 1, "", 0.5)]
    d = spark.createDataFrame(docs, "doc_id long, text string, share double")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i, chars_per_batch=9000).collect()} == want
    assert leakage.find_leaks(d, i.limit(0)).collect() == []
    assert leakage.find_leaks(d.limit(0), i).collect() == []


def test_the_number_of_passes_does_not_matter(spark):
    rnd = random.Random(4)
    phrase = "read every line of the passage below and then answer with one whole sentence"
    items = [(i, " ".join(f"i{i}w{rnd.randrange(60)}" for _ in range(rnd.choice([20, 60, 150]))) + " " + phrase) for i in range(60)] + ITEMS + [(900, ITEMS[0][1])]
    texts = [(i, FILLER + t + FILLER) for i, t in items if t] + [(1000, phrase), (1001, (phrase + " ") * 9), (1002, ITEMS[0][1] + " " + ITEMS[1][1])]
    d, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    total = sum(min(leakage.SKETCH * 1.2, len(t.split())) for _, t in items if t)
    first = None
    for per_pass in (4_000_000, int(total / 10), int(total / 40)):
        got = sorted(map(tuple, leakage.find_leaks(d, i, hashes_per_pass=per_pass).collect()))
        first = first or got
        assert got == first
    assert {(r[0], r[1]) for r in first} >= {(k, k) for k in range(60)} | {(1002, 1), (1002, 2), (1002, 900)}
    assert not {r[0] for r in first} & {1000, 1001}


def test_plain_text():
    assert plain.plain("Stra\u00dfe &amp; <b>Caf\u00e9</b> [the](#n) \\u00e4x").split() == ["strasse", "&", "cafe", "[the]", "ax"]


# --- stuffing

PROSE = "What the first mask reveals delays our visible trial. Each route touches this linear cache, as the last baseline covers. The score and the metric weakens the global station before every ledger is broken."
STUFFED = [
    "steel massage " * 80,
    ", ".join(f"{a} {b} {c}" for a in ("cheap", "best", "buy", "order") for b in ("garden", "kids") for c in ("tent", "sofa", "lamp")),
    "\n".join(f"- [cheap lamp](http://shop{i}.example/p?id={i})" for i in range(20)),
    "\n".join(f"SKU-{10000 + i * 7} | garden tent | red | sale | {i}.99" for i in range(20)),
    " ".join(f"#{a}{b}" for a in ("buy", "cheap", "top", "best") for b in ("Lamp", "Tent", "Sofa", "Mat")),
]
SOUND = [
    PROSE,
    "\n".join(f"step {i}/200 loss={i * 0.37:.3f} acc=0.{i} eta {200 - i}s" for i in range(100)),
    "\n".join(f"Warning: {x} is deep, using default" for x in ("matrix", "branch", "sensor", "contig", "model", "trial") * 20),
    "\n".join(f"velax{i}==1.{i}" for i in range(60)),
    "\n".join(f"{i}  {i * 1.7:.3f}  {i * -0.3:.4f}" for i in range(80)),
    "\n".join(f"- {PROSE[:60]}. [page](https://velax.example/{i})" for i in range(12)),
    "import numpy as np\nimport pandas as pd\n" * 20,
]


def test_short_paragraphs_are_judged_together():
    assert stuffing.stuffed_share("\n\n".join(["buy cheap shoes now"] * 200)) > 0.9
    assert stuffing.stuffed_share("\n\n".join(f"http://shop{i * 7}.example/p?id={i}" for i in range(200))) > 0.9
    assert stuffing.stuffed_share("\n\n".join(f"[lamp](http://shop{i * 7}.example/{i})" for i in range(200))) > 0.9
    assert stuffing.stuffed_share("The bike shop sells many parts. Part QW-1234 costs 12.50 and part QX-2345 costs 13.50 today.") == 0.0
    assert stuffing.stuffed_share("KeyError: 'x'\n" + "cheap lamp garden tent " * 60) > 0.9  # one line of a trace excuses no list


def test_the_ratio_follows_length_and_language():
    assert stuffing.expected_ratio(64) > stuffing.expected_ratio(1000) > stuffing.expected_ratio(10**6) > 0
    assert stuffing.expected_ratio(500, "ru") < stuffing.expected_ratio(500, "en") == stuffing.expected_ratio(500, None) < stuffing.expected_ratio(500, "zh")
    assert stuffing.language("Модель делит цепь", "en") == "ru" and stuffing.language("a plain text", "zh") is None and stuffing.language("Das Gen", "de") == "de"


def test_stuffed_blocks_and_sound_ones():
    assert all(stuffing.stuffed_share(x) > 0.5 for x in STUFFED)
    assert [stuffing.stuffed_share(x) for x in SOUND] == [0.0] * len(SOUND)


def test_share_decides_whatever_the_export(spark):
    import json

    docs = []
    for s in STUFFED:
        for more in (1, 40):
            paragraphs = [s, *[PROSE] * more]
            nb = json.dumps({"cells": [{"cell_type": "markdown", "source": [x]} for x in paragraphs], "metadata": {}})
            docs += [(more, "\n\n".join(paragraphs)), (more, "".join(f"# %% [markdown]\n# {x}\n\n".replace("\n", "\n# ")[:-2] for x in paragraphs)), (more, nb), (more, nb[:-30])]
    docs += [(40, None), (40, ""), (40, "   "), (40, "{"), (40, '{"cells": [')]
    df = spark.createDataFrame([(i, t, m) for i, (m, t) in enumerate(docs)], "doc_id long, text string, share int")
    found = {r.doc_id for r in stuffing.find_stuffed(df).collect()}
    big = {i for i, (m, t) in enumerate(docs) if m == 1 and len(t) > 4 * len(PROSE)}
    assert found >= big and not any(docs[i][0] == 40 for i in found)
    assert stuffing.find_stuffed(df.limit(0)).collect() == []


def test_cells_of_broken_notebooks():
    whole = '{"cells": [{"cell_type": "code", "source": ["a = 1\\n", "b"], "outputs": [{"text": "out\\u00e9"}]}, {"source": "tail text'
    assert [x.strip() for x in cells.blocks(whole)] == ["a = 1\nb", "out\u00e9", "tail text"]
