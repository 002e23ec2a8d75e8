"""The general problems against brute force: references, unreadable lines, coverage, hot keys."""

import random
from datetime import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import covered, orphans, parse_errors, skew

REFS = "src_table string, row_id long, ref string, loaded_at timestamp_ntz"
GENES = "name string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, src_table string"


def t(day, hour=0):
    return dt(2024, 3, day, hour)


def test_orphan_causes_ties_nulls_and_clashing_columns(spark):
    genes = spark.createDataFrame(
        [
            ("NM_1", t(2), None, "x"),
            ("nm_2.3 ", t(2), t(5), "x"),
            ("NM_2", t(2), t(4), "x"),
            ("NM_3", t(9), None, "x"),
            (None, t(1), None, "x"),
            ("  ", t(1), None, "x"),
            ("NM_4", t(2, 5), t(2, 5), "x"),
            ("NM_5", None, None, "x"),
            ("NM_6", t(1), t(2), "x"),
            ("NM_6", t(4), None, "x"),
        ],
        GENES,
    )
    refs = spark.createDataFrame(
        [
            ("a", 1, " nm_1.7 ", t(2)),  # loaded at the same moment: counts
            ("a", 2, "NM_1", t(1)),  # late
            ("a", 3, "NM_2", t(4, 3)),  # one of two still there
            ("a", 4, "NM_2", t(5)),  # deleted at that moment
            ("a", 5, "NM_3", t(5)),  # late
            ("a", 6, "NM_9", t(5)),  # missing
            ("a", 7, None, t(5)),
            ("a", 8, " ", t(5)),
            ("a", 9, "NM_4", t(3)),  # deleted as it came
            ("a", 10, "NM_5", t(3)),  # known key, never loaded
            ("a", 11, "NM_6", t(3)),  # deleted, though it comes again
            ("a", 12, "NM_6", t(6)),
            ("b", 6, "NM_9", None),  # missing whenever
            ("b", 7, "NM_1", None),
            ("a", 6, "NM_9", t(5)),  # repeated row
        ],
        REFS,
    )
    got = rows(orphans.find_orphans(refs, genes))
    m = "2024-03"
    want = [("a", 2, m, "late"), ("a", 4, m, "deleted"), ("a", 5, m, "late"), ("a", 6, m, "missing"), ("a", 6, m, "missing"), ("a", 9, m, "deleted"), ("a", 10, m, "late"), ("a", 11, m, "deleted"), ("b", 6, None, "missing")]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = spark.createDataFrame([], GENES)
    assert {r[3] for r in rows(orphans.find_orphans(refs, none))} == {"missing"}
    assert rows(orphans.find_orphans(spark.createDataFrame([], REFS), genes)) == []


def test_orphans_stay_exact_with_a_filter_that_is_far_too_small(spark, monkeypatch):
    rnd = random.Random(4)
    genes = [(f"K{rnd.randrange(3000)}", t(rnd.randrange(1, 28)), None if rnd.random() < 0.5 else t(rnd.randrange(1, 28)), "") for _ in range(4000)]
    refs = [("r", i, f"K{rnd.randrange(4000)}" if i % 3 else "K7", t(rnd.randrange(1, 28), rnd.randrange(24))) for i in range(3000)]
    by = {}
    for k, a, b, _ in genes:
        by.setdefault(k, []).append((a, b))
    want = []
    for s, i, k, at in refs:
        have = by.get(k)
        if not have:
            want.append((s, i, "2024-03", "missing"))
        elif not any(a <= at and (b is None or b > at) for a, b in have):
            want.append((s, i, "2024-03", "deleted" if any(a <= at for a, _ in have) else "late"))
    monkeypatch.setattr(orphans, "MIN_PAGES", 1)
    for rows_per_task in (2_000_000, 10):  # with and without salt
        got = rows(orphans.find_orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(genes, GENES), max_pages=2, rows_per_task=rows_per_task))
        assert got == sorted(want)


REASONS = [
    ("bed", "chr1\t1\t2", None),
    ("bed", "chr1\t1\t2\r", None),
    ("bed", "chr1\t 1 \t2\tn\t.5\t+", None),
    ("bed", "chr1\t1", "column_count"),
    ("bed", "chr1\t1\t2\tn\t5\t+\tx", "column_count"),
    ("bed", 'chr1\t1\t2\t"a\tb ""q"""\t5', None),
    ("bed", 'chr1\t1\t2\t"a', "quoting"),
    ("bed", 'chr1\t1\t2\t"a"b\t5', "quoting"),
    ("bed", 'chr1\t1\t2\t"a" \t5', "quoting"),
    ("bed", 'chr1\t1\t2\ta"b\t5', "quoting"),
    ("bed", 'chr1 "', "quoting"),
    ("bed", "chr1\t+1\t2", "start"),
    ("bed", "chr1\t３\t4", "start"),
    ("bed", "chr1\t9223372036854775808\t9223372036854775809", "start"),
    ("bed", "chr1\t9223372036854775807\t9223372036854775809", None),
    ("bed", "chr1\t0009\t8", "start"),
    ("bed", "chr1\t3\tend", None),
    ("bed", "chr1\t1\t2\tn\t1e", "score"),
    ("bed", "chr1\t1\t2\tn\t", "score"),
    ("bed", "chr1\t1\t2\tn\t-1.5E+3", None),
    ("bed", "chr1\tx\t2\tn\tbad", "start"),
    ("exon_counts", "n\t5", None),
    ("exon_counts", "n\t2147483648", "count"),
    ("exon_counts", "n\t-1", "count"),
    ("exon_counts", 'n\t"7"', None),
    ("exon_counts", "n\t5\t5", "column_count"),
    ("exon_counts", "", None),
    ("exon_counts", " \t ", None),
    ("bed", "#x\ty", None),
    ("bed", "track name", None),
    ("bed", "tracks", "column_count"),
    (None, "x", None),
    ("bed", None, None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, k, x) for i, (k, x, _) in enumerate(REASONS)], "line_id long, record_kind string, line string")
    got = {r.line_id: r for r in parse_errors.parse_lines(df).collect()}
    for i, (kind, line, reason) in enumerate(REASONS):
        record = kind and line and line.strip() and not line.startswith(("#", "track "))
        assert (got[i].reason if i in got else None) == reason and (i in got) == bool(record), (line, got.get(i))
        if record:
            assert (got[i].n_edits > 0) == (reason is not None) == (got[i].fields is None)


def test_the_dearest_class_of_the_cheapest_edits_is_the_reason():
    rnd = random.Random(3)
    lines = ["".join(rnd.choice('""\t\tab ') for _ in range(rnd.randrange(0, 14))) for _ in range(4000)]
    for least, most in ((3, 6), (2, 2), (1, 1)):
        for line, (q, d, ops) in zip(lines, parse_errors.cheapest_edits(lines, least, most)):
            fields = parse_errors.zero_cost(line)
            assert (q > 0) == (fields is None), line
            assert q + d == len(ops)
            if fields is not None:
                assert d == max(least - len(fields), len(fields) - most, 0), line
                assert all("delimiter" in x for x in ops)


def test_fewest_edits_against_a_search_of_all_edits():
    def near(line):
        for i in range(len(line) + 1):
            yield line[:i] + '"' + line[i:]
            yield line[:i] + "\t" + line[i:]
            if line[i : i + 1] == '"':
                yield line[:i] + line[i + 1 :]

    rnd = random.Random(9)
    for _ in range(300):
        line = "".join(rnd.choice('"\ta') for _ in range(rnd.randrange(1, 8)))
        best, seen, front = 0, {line}, [line]
        while not any(parse_errors.zero_cost(x) is not None for x in front):
            front = [y for x in front for y in near(x) if y not in seen]
            seen.update(front)
            best += 1
        q, d, _ = parse_errors.cheapest_edits([line])[0]
        assert (q, d) == (best, 0), line


def test_quote_edits_repair_the_line():
    def apply(line, edits):
        for e in reversed(edits):
            op, at = e.split("@")
            at = int(at)
            line = line[:at] + line[at + 1 :] if op == "delete_quote" else line[:at] + ('"' if op == "insert_quote" else "\t") + line[at:]
        return line

    rnd = random.Random(1)
    for _ in range(3000):
        line = "".join(rnd.choice('"\tab ') for _ in range(rnd.randrange(1, 12)))
        if parse_errors.zero_cost(line) is None:
            edits = parse_errors.quote_edits(line)
            assert edits
            assert parse_errors.zero_cost(apply(line, edits)) is not None, (line, edits)
    assert parse_errors.quote_edits('a\t"b') in (["delete_quote@2"], ["insert_quote@4"])
    long = 'x"' * 5000
    assert len(parse_errors.quote_edits(long)) > 0


def test_parse_lines_keeps_extra_columns_out_and_loads_typed(spark):
    df = spark.createDataFrame([(1, "bed", 'chr1\t5\t9\t"n 1"\t2.5\t-', "r"), (2, "bed", "chr1\tq\t9", "r"), (3, "exon_counts", "e\t7", "r"), (4, "bed", None, "r")], "line_id long, record_kind string, line string, reason string")
    parsed = parse_errors.parse_lines(df)
    assert rows(parse_errors.rejected(parsed)) == [(2, "start")]
    assert rows(parse_errors.loaded_bed(parsed)) == [(1, "chr1", 5, 9, "n 1", 2.5, "-")]
    assert rows(parse_errors.loaded_counts(parsed)) == [(3, "e", 7)]
    assert rows(parse_errors.parse_lines(df.limit(0))) == []


def brute_periods(items):
    by = {}
    for k, s, e in items:
        if s is not None and e is not None and s < e:
            by.setdefault(k, []).append((s, e))
    out = []
    for k, v in by.items():
        merged = []
        for s, e in sorted(v):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged] + [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [4, 64, 1 << 20])
def test_periods_across_slices(spark, width):
    rnd = random.Random(width)
    items = []
    for i in range(1500):
        s = rnd.randrange(-50, 900)
        items.append((rnd.choice(["a", "b", None, "c"]) if i % 3 else "hot", s, s + rnd.choice([0, 1, 2, 3, 7, 60, -4])))
    items += [("one", 5, 6), ("nest", 0, 100), ("nest", 10, 20), ("touch", 0, 4), ("touch", 4, 8), ("x", None, 5), ("x", 5, None)]
    items += items[:50]
    df = spark.createDataFrame(items, "k string, start long, end long")
    got = sorted((tuple(r) for r in covered.periods_and_gaps(df, ["k"], width=width).collect()), key=str)
    assert got == brute_periods(items)


def test_long_intervals_and_small_maps(spark, monkeypatch):
    monkeypatch.setattr(covered, "MOST_SLICES", 64)
    monkeypatch.setattr(covered, "HELD", 20)
    rnd = random.Random(8)
    items = [("a", 0, 1 << 40), ("b", -(1 << 50), 5), ("b", 1 << 50, (1 << 50) + 1)] + [("c", s, s + rnd.randrange(1, 90)) for s in (rnd.randrange(5000) for _ in range(400))]
    df = spark.createDataFrame(items, "k string, start long, end long")
    assert sorted((tuple(r) for r in covered.periods_and_gaps(df, ["k"], width=8).collect()), key=str) == brute_periods(items)


def test_interval_map_against_a_bit_set():
    rnd = random.Random(5)
    for _ in range(200):
        m, bits = covered.IntervalMap(), set()
        for _ in range(rnd.randrange(1, 20)):
            s = rnd.randrange(0, 40)
            e = s + rnd.randrange(-1, 9)
            m.insert(s, e)
            bits |= set(range(s, e))
        assert set().union(*(range(a, b) for a, b in zip(m.starts, m.ends))) == bits
        assert all(b < c for b, c in m.gaps())


def test_covered_runs_drops_what_takes_no_part(spark):
    df = spark.createDataFrame([("t", " chr1 ", 1, 5, " +"), ("t", "chr1", 5, 9, "+"), ("t", "chr1", 20, 21, "+"), ("t", None, 1, 2, "+"), ("t", "chr1", 1, 2, "."), ("t", "chr1", 1, 2, None), (None, "chr1", 1, 2, "-")], "track_id string, chrom string, start long, end long, strand string")
    got = sorted((tuple(r) for r in covered.covered_runs(df).collect()), key=str)
    assert got == sorted([("t", "chr1", "+", "period", 1, 9), ("t", "chr1", "+", "period", 20, 21), ("t", "chr1", "+", "gap", 9, 20), (None, "chr1", "-", "period", 1, 2)], key=str)
    assert covered.covered_runs(df.limit(0)).collect() == []


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_top_per_key_with_hot_keys_ties_and_nulls(spark, share):
    rnd = random.Random(2)
    data = [("hot" if i % 2 else rnd.choice([f"k{j}" for j in range(40)] + [None]), rnd.randrange(30), i) for i in range(2000)]
    df = spark.createDataFrame(data, "chrom string, score int, id long")
    got = rows(skew.top_per_key(df, "chrom", [F.col("score").desc(), F.col("id")], 3, F.col("id"), share=share).select("chrom", "id"))
    by = {}
    for k, s, i in data:
        if k is not None:
            by.setdefault(k, []).append((-s, i))
    assert got == sorted((k, i) for k, v in by.items() for _, i in sorted(v)[:3])
    assert skew.top_per_key(df.limit(0), "chrom", [F.col("score").desc()], 3, F.col("id")).collect() == []
