"""Very long texts stay linear, and odd ones have a defined result."""

import time

import pytest

pytest.importorskip("spanloom.llm")

from spanloom.llm import cells, leakage, plain, stuffing  # noqa: E402

from tools import leaks  # noqa: E402

N = 400_000
LONG = {
    "newlines": "\n" * N,
    "blanks": " " * N,
    "one word": "x" * N,
    "quotes": '"' * N,
    "apostrophes": "it's " * (N // 5),
    "backslashes": "\\" * N,
    "brackets": "[" * N,
    "angles": "<a " * (N // 3),
    "backticks": "```\n" * (N // 4),
    "lines": "# %% \n# word word.\n" * (N // 20),
    "hashtags": "#tag " * (N // 5),
    "links": "http://a.example/b " * (N // 19),
    "dashes": "a-\n" * (N // 3),
    "broken": '{"cells": [{"source": ["' + 'ab\\n", "' * (N // 8),
    "nested": '{"cells": ' + "[" * 5000,
    "ideographs": "汉" * N,
    "marks": "é​" * (N // 3),
}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_linear_time(name):
    began = time.process_time()
    text = LONG[name]
    assert 0.0 <= stuffing.stuffed_share(text) <= 1.0
    cells.blocks(text)
    plain.word_hashes([plain.plain(text)])
    # a quadratic step over 400,000 characters would take minutes
    assert time.process_time() - began < 30


def test_passage_in_a_long_text():
    item = "Opposite the quarry Quilulaa dried 912 rusted pegs, and some clerk sketched 15 salt keys in secret near the fountain."
    text = "never halves the output " * 100_000 + item + " never halves the output" * 100_000
    assert list(leaks([(7, item)], ["", text])) == [(1, 7, 1.0)]


def test_shared_phrases_and_repeats_are_no_passage():
    phrase = "Choose the best answer and explain your reasoning in two sentences."
    body = "Lomarrason heard how one gardener weighed 932 reed pans for a small fee beside the drawbridge while another fletcher soaked 44 nets."
    its = [(1, body + " " + phrase), (2, "Siletha auctioned 80 ladders before the stormy eclipse and copied what remained beyond the kiln of her saddler. " + phrase)]
    assert [x for x in leaks(its, [(phrase + " ") * 50]) if x[2] >= leakage.LEAST] == []
    short = " ".join(body.split()[:6])
    assert [x for x in leaks(its, [(short + " filler words here. ") * 50]) if x[2] >= leakage.LEAST] == []


def test_items_under_four_words_match_nothing():
    its = [(1, "one two"), (2, ""), (3, "one two three")]
    assert list(leaks(its, ["one two three one two three"])) == []
    assert list(leaks(its, [])) == []


def test_tags_and_link_targets_of_any_length_are_no_words():
    tag = '<div style="' + "color: red; " * 1000 + '">'
    assert plain.plain(f"one {tag} two</div> three").split() == ["one", "two", "three"]
    assert plain.plain("for (i=0; i <n; i++) x = y[i] -> z").split() == "for (i=0; i <n; i++) x = y[i] -> z".split()
    assert plain.plain("see [this](http://a.example/" + "x" * 5000 + ") now").split() == ["see", "[this]", "now"]


def test_sketches_of_long_items_find_nearly_all_that_whole_items_find():
    import random

    rnd = random.Random(12)
    items = [(i, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))) for i, n in enumerate([130, 160, 200, 300, 500, 900, 2000] * 6)]
    texts, want = [], set()
    for i, t in items:
        w = t.split()
        for _ in range(6):
            n = int(len(w) * rnd.uniform(0.42, 0.6))
            s = rnd.randrange(len(w) - n)
            cut = [f"z{rnd.randrange(10**9)}" if rnd.random() < 0.1 else x for x in w[s : s + n]]
            texts.append("never halves the output " * 50 + " ".join(cut) + " never halves the output" * 50)
    want = {(d, i) for d, i, share in leaks(items, texts, size=10**9) if share >= leakage.LEAST}
    got = {(d, i) for d, i, share in leaks(items, texts) if share >= leakage.LEAST}
    assert len(want) > 150 and got <= want and len(got) >= 0.98 * len(want)
    kept = sum(len(leakage.sketch(leakage._shingles(plain.word_hashes([t])[0]))) for _, t in items)
    assert kept < 50 * len(items)


def test_a_text_of_twenty_megabytes_is_split(spark):
    from spanloom.llm import split

    line = 'Some words stand here. And a few more words\n'
    n = 20_000_000 // len(line)
    df = spark.createDataFrame([(1,)], "doc_id long").selectExpr("doc_id", f"repeat('{line[:-1]}\\n', {n}) as text")
    pieces = split.split_texts(df, 1000, 100).selectExpr("piece_no", "piece_start", "length(piece) as n").orderBy("piece_no").collect()
    assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1))
    assert all(b.piece_start == a.piece_start + a.n - 100 and a.n <= 1000 for a, b in zip(pieces, pieces[1:]))
    assert pieces[-1].piece_start + pieces[-1].n == n * len(line)


def test_regions_equal_the_regular_expression_over_one_character_a_base(spark):
    import random
    import re

    from spanloom.llm import split

    rnd = random.Random(6)
    limit, least, overlap = 100, 50, 20
    regions = [(i, "c", s, s + rnd.randrange(0, 3000)) for i, s in enumerate(rnd.randrange(-2000, 2000) for _ in range(60))]
    breaks = sorted({rnd.randrange(-2500, 5000) for _ in range(150)})
    have, want = set(breaks), []
    for i, _, s, e in regions:
        if e - s <= limit:
            continue
        text = "".join("B" if x in have else "." for x in range(s + 1, e + 1))
        one = lambda a, b: rf"[.B]{{1,{b}}}\Z|[.B]{{{a},{b - 1}}}B|[.B]{{1,{b}}}"
        at = re.match(one(least, limit), text).end()
        want.append((i, 1, s, s + at))
        for no, m in enumerate(re.compile(one(least - overlap, limit - overlap)).finditer(text, at), 2):
            want.append((i, no, s + m.start() - overlap, s + m.end()))
    r = spark.createDataFrame(regions, "region_id long, chrom string, start long, end long")
    b = spark.createDataFrame([("c", x) for x in breaks], "chrom string, pos long")
    got = split.split_regions(r, b, limit, least, overlap)
    assert sorted(map(tuple, got.collect())) == sorted(want)
