"""Functions of nucleotide sequences and of reads with qualities, as columns.

Sequences are strings with ``-`` for gaps; positions are as each function says. All are built-in expressions that
stay inside code generation, but for two that work on Arrow batches (adaptors, pieces by position); nulls
give null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Complements, both cases; N stays N.
DNA, DNA_C = "ACGTNacgtn", "TGCANtgcan"
RNA, RNA_C = "ACGUNacgun", "UGCANugcan"
PHRED = {"33": 33, "64": 64}


def _s(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _n(c: Column | int) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def gapped_len(seq: Column | str) -> Column:
    return F.length(_s(seq))


def ungapped_len(seq: Column | str, start: Column | None = None, end: Column | None = None) -> Column:
    """Symbols other than gaps; with coordinates they must agree."""
    n = F.length(F.replace(_s(seq), F.lit("-"), F.lit("")))
    if start is None or end is None:
        return n
    return F.when(n == end - start, n).when(n != end - start, F.raise_error(F.lit("length and coordinates disagree")).cast("int"))


def effective_len(seq: Column | str) -> Column:
    """Symbols other than N and n; gaps count."""
    return F.length(F.translate(_s(seq), "Nn", ""))


def unknown_len(seq: Column | str, start: Column, end: Column) -> Column:
    """Length of a sequence whose symbols may be unknown (null): then what the coordinates say."""
    return F.coalesce(ungapped_len(seq).cast("long"), end - start)


def nucleotide(seq: Column | str, i: Column | int) -> Column:
    """Symbol at index ``i`` from 0; beyond the end fails."""
    s, i = _s(seq), _n(i)
    return F.when((i >= 0) & (i < F.length(s)), F.substring(s, i + 1, F.lit(1))).when(s.isNotNull() & i.isNotNull(), F.raise_error(F.lit("index out of range")).cast("string"))


def percent_nuc(seq: Column | str, nuc: str) -> Column:
    """Share of a symbol; null for the empty sequence."""
    s = _s(seq)
    return F.try_divide(F.length(s) - F.length(F.replace(s, F.lit(nuc), F.lit(""))), F.length(s))


def is_dna(seq: Column | str) -> Column:
    return _s(seq).rlike(f"^[{DNA}]*$")


def is_rna(seq: Column | str) -> Column:
    return _s(seq).rlike(f"^[{RNA}]*$")


def to_rna(seq: Column | str) -> Column:
    """Upper-case T becomes U; lower case stays."""
    return F.translate(_s(seq), "T", "U")


def to_dna(seq: Column | str) -> Column:
    return F.translate(_s(seq), "U", "T")


def reverse_complement(seq: Column | str, rna: bool | None = False) -> Column:
    """Case and N are kept; any other symbol (a gap too) fails. ``rna=None`` takes RNA where there is no T."""
    s = _s(seq)
    dna, as_rna = F.reverse(F.translate(s, DNA, DNA_C)), F.reverse(F.translate(s, RNA, RNA_C))
    bad = F.raise_error(F.concat(F.lit("no complement in "), s)).cast("string")
    checked_dna, checked_rna = F.when(is_dna(s), dna).when(s.isNotNull(), bad), F.when(is_rna(s), as_rna).when(s.isNotNull(), bad)
    return checked_rna if rna else checked_dna if rna is False else F.when(is_rna(s), as_rna).otherwise(checked_dna)


def ns_left(seq: Column | str, n: Column | int) -> Column:
    """The first ``n`` symbols as N."""
    s = _s(seq)
    k = F.least(_n(n), F.length(s))
    return F.concat(F.repeat(F.lit("N"), k), F.substring(s, k + 1, F.length(s)))


def ns_right(seq: Column | str, n: Column | int) -> Column:
    """The last ``n`` symbols as N; 0 changes nothing."""
    s = _s(seq)
    k = F.least(_n(n), F.length(s))
    return F.concat(F.substring(s, F.lit(1), F.length(s) - k), F.repeat(F.lit("N"), k))


def mask_region(seq: Column | str, start: Column | int, end: Column | int) -> Column:
    """N from ``start`` to ``end``, both from 0 and both included; outside the sequence fails."""
    s, a, b = _s(seq), _n(start), _n(end)
    ok = (a >= 0) & (b >= a) & (b < F.length(s))
    return F.when(ok, F.concat(F.substring(s, F.lit(1), a), F.repeat(F.lit("N"), (b - a + 1).cast("int")), F.substring(s, b + 2, F.length(s)))).when(s.isNotNull(), F.raise_error(F.lit("region out of range")).cast("string"))


def mask_regions(seq: Column | str, regions: Column | str) -> Column:
    """All of an array of structs (s, e) masked, as ``mask_region`` does one."""
    return F.aggregate(_s(regions), _s(seq), lambda acc, r: mask_region(acc, r["s"].cast("int"), r["e"].cast("int")))


def truncate(seq: Column | str, n: Column | int) -> Column:
    return F.substring(_s(seq), F.lit(1), _n(n))


def split_at(seq: Column | str, name: Column | str, point: Column | int | None = None) -> Column:
    """Two structs (name, seq): the halves, named ``.1`` and ``.2``; the middle is rounded down."""
    s, n = _s(seq), _s(name)
    at = F.floor(F.length(s) / 2).cast("int") if point is None else _n(point)
    return F.array(F.struct(F.concat(n, F.lit(".1")).alias("name"), F.substring(s, F.lit(1), at).alias("seq")), F.struct(F.concat(n, F.lit(".2")).alias("name"), F.substring(s, at + 1, F.length(s)).alias("seq")))


def similarity(a: Column | str, s1: Column | int, e1: Column | int, b: Column | str, s2: Column | int, e2: Column | int) -> Column:
    """Equal symbols of two pieces, from 0, both ends included; pieces of unequal length fail."""
    s1, e1, s2, e2 = map(_n, (s1, e1, s2, e2))
    x, y = F.substring(_s(a), s1 + 1, e1 - s1 + 1), F.substring(_s(b), s2 + 1, e2 - s2 + 1)
    same = F.size(F.filter(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: p == q), lambda v: v))
    return F.when(e1 - s1 == e2 - s2, same).otherwise(F.raise_error(F.lit("pieces differ in length")).cast("int"))


def is_poly(seq: Column | str, nuc: str, least: float = 0.9) -> Column:
    """At least ``least`` of the symbols are ``nuc``."""
    return percent_nuc(seq, nuc) >= least


def is_low_quality(seq: Column | str, least: float = 0.1) -> Column:
    return percent_nuc(seq, "N") >= least


def mask_match(seq: Column | str, mask: Column | str) -> Column:
    """The sequence begins as the mask says; N and n in the mask stand for any symbol, a longer mask never matches."""
    s, m = _s(seq), _s(mask)
    pairs = F.zip_with(F.split(F.substring(s, F.lit(1), F.length(m)), ""), F.split(m, ""), lambda p, q: q.isin("N", "n") | (p == q))
    return F.when(F.length(m) == 0, F.lit(True)).when(F.length(m) > F.length(s), F.lit(False)).otherwise(F.forall(pairs, lambda v: F.coalesce(v, F.lit(False))))


def clip_starts(seqs: list[str], adaptor: str, matches: np.ndarray) -> np.ndarray:
    """Per sequence the index (may be negative) of the rightmost adaptor window with so many equal symbols; -k if there is none.

    Windows lie inside the sequence or hang over its 5' end. All sequences stand in one flat array, so the work is one
    comparison of whole arrays per symbol of the adaptor.
    """
    k = len(adaptor)
    size = np.array([len(s) for s in seqs], np.int64)
    if k == 0 or not len(seqs):
        return np.where(matches <= 0, size, -k)
    # k - 1 blanks before each sequence, k after it
    flat = np.frombuffer("".join("\0" * (k - 1) + s + "\0" * k for s in seqs).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(size + 2 * k - 1) - (size + 2 * k - 1)
    hits = np.zeros(len(flat) - k + 1, np.int32)
    for j, c in enumerate(adaptor):
        hits += flat[j : j + len(hits)] == ord(c)
    row = np.repeat(np.arange(len(seqs)), size + 2 * k - 1)[: len(hits)]
    i = np.arange(len(hits)) - begin[row] - (k - 1)
    good = np.flatnonzero((hits >= matches[row]) & (i <= np.maximum(size - k, -1)[row]))
    out = np.full(len(seqs), -k)
    np.maximum.at(out, row[good], i[good])
    return out


@F.pandas_udf(LongType())
def _clip_start(seq: pd.Series, adaptor: pd.Series, matches: pd.Series) -> pd.Series:
    """``clip_starts`` over a batch, by adaptor; null where there is no window or an argument is null."""
    out = pd.Series([None] * len(seq), dtype="Int64")
    have = seq.notna() & adaptor.notna() & matches.notna()
    for a, rows in adaptor[have].groupby(adaptor[have]).groups.items():
        at = clip_starts(seq[rows].tolist(), a, matches[rows].to_numpy(np.int64))
        out[rows] = pd.array(at, "Int64")
        out[rows[at == -len(a)]] = pd.NA
    return out


def clip_end(seq: Column | str, adaptor: Column | str, matches: Column | int) -> Column:
    """N from the adaptor's place to the end: the first window from the right with that many equal symbols."""
    s, a = _s(seq), _s(adaptor)
    at = _clip_start(s, a, _n(matches))
    keep = F.greatest(at, F.lit(0)).cast("int")
    return F.when(at.isNull(), s).otherwise(F.concat(F.substring(s, F.lit(1), keep), F.repeat(F.lit("N"), F.length(s) - keep)))


def clip_adaptor(seq: Column | str, adaptor: Column | str) -> Column:
    """``clip_end`` with the adaptor's first ten symbols, two of which may differ."""
    a = F.substring(_s(adaptor), 1, 10)
    return clip_end(seq, a, F.length(a) - 2)


def contains_adaptor(seq: Column | str, adaptor: Column | str) -> Column:
    return clip_adaptor(seq, adaptor) != _s(seq)


def gapped_subsequence(seq: Column | str, start: Column, strand: Column, remaining: Column, first: Column | int, stop: Column | int) -> Column:
    """Columns [first, stop), from 1, of a gapped sequence with its new coordinates: struct (seq, start, end, remaining)."""
    s, a, b = _s(seq), _n(first), _n(stop)
    piece = F.substring(s, a, b - a)
    bases = lambda c: F.length(F.replace(c, F.lit("-"), F.lit(""))).cast("long")
    before, inside = bases(F.substring(s, F.lit(1), a - 1)), bases(piece)
    after = bases(s) - before - inside
    new = F.when(F.coalesce(strand, F.lit("+")) == "-", start + after).otherwise(start + before)
    # what remains of the whole sequence after the piece
    return F.struct(piece.alias("seq"), new.alias("start"), (new + inside).alias("end"), (remaining + F.when(F.coalesce(strand, F.lit("+")) == "-", before).otherwise(after)).alias("remaining"))


@F.pandas_udf(StringType())
def _bases_between(seq: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """The piece from base ``lo`` to before base ``hi`` (counted from 0), without gaps at its rims."""
    out = []
    for s, a, b in zip(seq, lo, hi):
        if s is None or pd.isna(a) or pd.isna(b):
            out.append(None)
            continue
        at = np.flatnonzero(np.frombuffer(s.encode("utf-32-le"), np.uint32) != ord("-"))[max(0, int(a)) : max(0, int(b))]
        out.append(s[at[0] : at[-1] + 1] if len(at) else "")
    return pd.Series(out, dtype=object)


def subsequence(seq: Column | str, start: Column, first: Column, stop: Column) -> Column:
    """The gapped piece that holds the bases at absolute positions [first, stop) of a sequence that begins at ``start``.

    Gaps inside the piece are kept, those at its rims are not.
    """
    return _bases_between(_s(seq), (first - start).cast("long"), (stop - start).cast("long"))


def equal_sequences(a: str, b: str) -> Column:
    """Equal seq, name, meta, start, end and remaining of two sequences by their columns' prefixes; nulls are equal."""
    out = F.lit(True)
    for c in ("seq", "name", "start", "end", "remaining"):
        out &= F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}"))
    pairs = [F.array_sort(F.map_entries(f"{x}meta")) for x in (a, b)]
    return out & pairs[0].eqNullSafe(pairs[1])


def merge_maps(a: Column | str, b: Column | str) -> Column:
    """All pairs of two maps; a key of both has the second's value."""
    x, y = _s(a), _s(b)
    return F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y)


def meta_to_string(meta: Column | str) -> Column:
    """``k=v`` pairs by key, separated by blanks."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_s(meta))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")


# --- reads


def check_read(df: DataFrame, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """``df``, failing at run time where sequence and quality differ in length."""
    bad = F.raise_error(F.concat(F.lit("sequence and quality differ in length: "), F.col(seq))).cast("string")
    return df.withColumn(qual, F.when(F.length(seq) == F.length(qual), F.col(qual)).when(F.col(qual).isNotNull() & F.col(seq).isNotNull(), bad))


def trim_right(c: Column | str, n: Column | int) -> Column:
    s = _s(c)
    return F.substring(s, F.lit(1), F.greatest(F.length(s) - _n(n), F.lit(0)))


def trim_left(c: Column | str, n: Column | int) -> Column:
    s = _s(c)
    return F.substring(s, _n(n) + 1, F.length(s))


def relative_quality(qual: Column | str, i: Column | int, encoding: str = "33") -> Column:
    """Quality score at index ``i`` from 0 under Phred+33 or Phred+64; an index outside fails."""
    q, i = _s(qual), _n(i)
    ok = (i >= 0) & (i < F.length(q))
    return F.when(ok, F.ascii(F.substring(q, i + 1, F.lit(1))) - PHRED[encoding]).when(q.isNotNull(), F.raise_error(F.lit("index out of range")).cast("int"))


def mean_quality(qual: Column | str, encoding: str = "33") -> Column:
    q = _s(qual)
    total = F.aggregate(F.split(q, ""), F.lit(0), lambda a, c: a + F.ascii(c) - PHRED[encoding])
    return F.when(F.length(q) > 0, total / F.length(q))


def reverse_complement_read(seq: Column | str = "seq", qual: Column | str = "qual", rna: bool | None = None) -> Column:
    """Struct (seq, qual) of a read turned round: the complement backwards, with its qualities."""
    return F.struct(reverse_complement(seq, rna).alias("seq"), F.reverse(_s(qual)).alias("qual"))


def split_read(seq: Column | str = "seq", qual: Column | str = "qual", name: Column | str = "name", point: Column | int | None = None) -> Column:
    """Two structs (name, seq, qual) as ``split_at``; a point outside [0, length] fails."""
    s, q, n = _s(seq), _s(qual), _s(name)
    at = F.floor(F.length(s) / 2).cast("int") if point is None else _n(point)
    at = F.when((at >= 0) & (at <= F.length(s)), at).when(s.isNotNull(), F.raise_error(F.lit("no such place to split a read at")).cast("int"))
    part = lambda tag, c: [F.concat(n, F.lit(tag)).alias("name"), c(s).alias("seq"), c(q).alias("qual")]
    return F.array(F.struct(*part(".1", lambda x: F.substring(x, F.lit(1), at))), F.struct(*part(".2", lambda x: F.substring(x, at + 1, F.length(x)))))


def merge_reads(a: str, b: str, force: bool = False) -> tuple[Column, Column, Column]:
    """(name, seq, qual) of two reads put together; names must be equal unless forced."""
    name = F.when(F.lit(force) | (F.col(f"{a}_name") == F.col(f"{b}_name")), F.col(f"{a}_name")).otherwise(F.raise_error(F.lit("names differ")).cast("string"))
    return name, F.concat(f"{a}_seq", f"{b}_seq"), F.concat(f"{a}_qual", f"{b}_qual")
