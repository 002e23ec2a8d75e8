"""Rows that fail to parse: a minimum-cost error parse that either loads a line or says which edits it would take.

A line that no edit is needed for loads if its fields have their types. Which edits the others need is found by dynamic
programming over the line's tokens (quotes, tabs and runs of anything else). Its table has a cell for each of four states
(field start, bare field, quoted field, after a closing quote) and each number of fields begun so far; a step inserts or
deletes a quote or a delimiter, or takes the token as it is. Edits cost by class, and a dearer class outweighs any number
of a cheaper one:

1. quoting: a quote inserted or deleted, and a delimiter inserted next to a quote, where it only mends the quoting;
2. column count: a delimiter inserted anywhere else, or deleted, which joins the contents of two fields;
3. type: a field written anew as a number.

The class of the dearest edit of the cheapest parse is the reason: ``quoting``, ``column_count`` or the field's name. A
line without a quote and with a number of tabs that its kind allows is its own cheapest parse, so it never leaves the JVM;
all others go through the program, many lines at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from spanloom.common import BLANKS, once, strip

START, BARE, QUOTED, CLOSED = range(4)
END, QUOTE, TAB, RUN = range(4)
#: Cost of an edit of the first and of the second class; costs add up in one number.
Q, D, NEVER = np.int64(1 << 32), np.int64(1), np.int64(1 << 60)
TOKEN = re.compile(r'"|\t|[^"\t]+')
FIELD = re.compile(r'"(?:[^"]+|"")*+"(?=\t|\Z)|[^"\t]*+(?=\t|\Z)')
MAX64, MAX32 = 2**63 - 1, 2**31 - 1
#: Tokens whose tables are held at a time.
TOKENS_PER_BATCH = 400_000


@dataclass(frozen=True)
class Kind:
    """A record kind: the least and the greatest number of its fields."""

    least: int
    most: int


KINDS = {"bed": Kind(3, 6), "exon_counts": Kind(2, 2)}


def zero_cost(line: str) -> list[str] | None:
    """The fields of the parse without edits, contents without surrounding blanks; null if there is none."""
    if '"' not in line:
        return [x.strip(BLANKS) for x in line.split("\t")]
    fields, at = [], 0
    while True:
        m = FIELD.match(line, at)
        if not m:
            return None
        x = m.group()
        fields.append((x[1:-1].replace('""', '"') if x[:1] == '"' else x).strip(BLANKS))
        if m.end() == len(line):
            return fields
        at = m.end() + 1


def _lower(into: np.ndarray, by: np.ndarray, cost: np.ndarray, code: int) -> None:
    """``into`` becomes ``cost`` where that is less, and ``by`` notes the step taken."""
    better = cost < into
    into[better] = cost[better]
    by[better] = code


def _insert(c: np.ndarray, tok: np.ndarray, counted: bool, by: np.ndarray) -> None:
    """Insertions before a token, the cheapest into each cell of ``c`` (state, fields, line); ``by`` notes the steps taken."""
    beside = np.where(tok == QUOTE, Q, D)
    closing = np.where((tok == QUOTE) | (tok == RUN), Q, D)
    for j in range(c.shape[1]):
        _lower(c[QUOTED, j], by[QUOTED, j], c[START, j] + Q, 1 + START)
        _lower(c[CLOSED, j], by[CLOSED, j], c[QUOTED, j] + Q, 1 + QUOTED)
        k = j + 1 if counted else j
        if k < c.shape[1]:
            for s, cost in ((BARE, beside), (CLOSED, closing), (START, D)):
                if counted or s != START:
                    _lower(c[START, k], by[START, k], c[s, j] + cost, 9 + s)
        if not counted:  # a delimiter leads back to a field's start in the same cell
            _lower(c[QUOTED, j], by[QUOTED, j], c[START, j] + Q, 1 + START)


def _take(c: np.ndarray, tok: np.ndarray, counted: bool, by: np.ndarray) -> np.ndarray:
    """The cells after a token; ``by`` notes the steps taken: state before, 4 for the next field, 8 for an edit."""
    out = np.full(c.shape, NEVER)
    quote, tab, run = tok == QUOTE, tok == TAB, tok == RUN

    def step(to: int, s: int, where: np.ndarray, cost: np.int64 | int, shift: bool = False, edit: bool = False) -> None:
        a, b = (out[to, 1:], by[to, 1:]) if shift and counted else (out[to], by[to])
        old = c[s, :-1] if shift and counted else c[s]
        _lower(a, b, np.where(where, old + cost, NEVER), s | 4 * (shift and counted) | 8 * edit)

    step(QUOTED, QUOTED, tab | run, 0)
    step(QUOTED, START, quote, 0)
    step(QUOTED, CLOSED, quote, 0)
    step(CLOSED, QUOTED, quote, 0)
    step(BARE, START, run, 0)
    step(BARE, BARE, run, 0)
    for s in (START, BARE, CLOSED):
        step(START, s, tab, 0, shift=True)
    for s in range(4):
        step(s, s, quote, Q, edit=True)
    for s in (START, BARE, CLOSED):
        step(START, s, tab, D, edit=True)
    return out


def _trace(at: int, tokens: list[tuple[int, int]], length: int, inserted: np.ndarray, taken: np.ndarray, s: int, j: int) -> list[str]:
    """The edits of line ``at`` that end in the cell (s, j), as ``op@offset`` in the line's order."""
    ops: list[str] = []
    for t in range(len(tokens), -1, -1):
        place = tokens[t][1] if t < len(tokens) else length
        for _ in range(64):
            b = int(inserted[t, s, j, at])
            if not b:
                break
            if b < 9:
                ops.append(f"insert_quote@{place}")
                s = b - 1
            else:
                ops.append(f"insert_delimiter@{place}")
                s = b - 9
                j = j - 1 if inserted.shape[2] > 1 else j
        if t:
            b = int(taken[t - 1, s, j, at])
            if b & 8:
                ops.append(f"delete_{'quote' if tokens[t - 1][0] == QUOTE else 'delimiter'}@{tokens[t - 1][1]}")
            s, j = b & 3, j - 1 if b & 4 else j
    return ops[::-1]


def cheapest_edits(lines: list[str], least: int = 1, most: int | None = None) -> list[tuple[int, int, list[str]]]:
    """(edits of the quoting, edits of the column count, all of them) of each line's cheapest parse.

    The parse has ``least`` to ``most`` fields, any number without ``most``. The cost is linear in a line's tokens.
    """
    codes = {'"': QUOTE, "\t": TAB}
    tokens = [[(codes.get(m[0], RUN), m.start()) for m in TOKEN.finditer(x)] for x in lines]
    order = sorted(range(len(lines)), key=lambda i: -len(tokens[i]))
    out: list = [None] * len(lines)
    lo = 0
    while lo < len(order):
        hi = lo + max(1, TOKENS_PER_BATCH // max(1, len(tokens[order[lo]])))
        mine = order[lo:hi]
        lo = hi
        for i, x in zip(mine, _cheapest([lines[i] for i in mine], [tokens[i] for i in mine], least, most)):
            out[i] = x
    return out


def _cheapest(lines: list[str], tokens: list[list[tuple[int, int]]], least: int, most: int | None) -> list[tuple[int, int, list[str]]]:
    size = np.array([len(t) for t in tokens])
    steps = int(size[0]) if len(size) else 0
    code = np.zeros((steps + 1, len(lines)), np.uint8)
    for i, t in enumerate(tokens):
        code[: len(t), i] = [x[0] for x in t]
    c = np.full((4, most or 1, len(lines)), NEVER)
    c[START, 0] = 0
    inserted, taken = (np.zeros((steps + 1, *c.shape), np.uint8) for _ in range(2))
    last = np.full(c.shape, NEVER)
    for t in range(steps + 1):
        here = int(np.searchsorted(-size, -t, "right"))  # lines of at least t tokens stand first
        c = c[:, :, :here]
        _insert(c, code[t, :here], most is not None, inserted[t, :, :, :here])
        ended = int(np.searchsorted(-size, -t - 1, "right"))
        last[:, :, ended:here] = c[:, :, ended:]
        if t < steps:
            c = _take(c[:, :, :ended], code[t, :ended], most is not None, taken[t, :, :, :ended])
    states = (START, BARE, CLOSED)
    ends = last[states, (least - 1 if most else 0) :]
    flat = ends.reshape(-1, len(lines))
    best = flat.argmin(0)
    cost = flat[best, np.arange(len(lines))]
    out = []
    for i, (b, x) in enumerate(zip(best.tolist(), cost.tolist())):
        s, j = states[b // ends.shape[1]], b % ends.shape[1] + (least - 1 if most else 0)
        out.append((x >> 32, x & 0xFFFFFFFF, _trace(i, tokens[i], len(lines[i]), inserted, taken, s, j) if x else []))
    return out


PARSED = StructType().add("quoting", LongType()).add("columns", LongType()).add("edits", ArrayType(StringType())).add("fields", ArrayType(StringType()))


def quote_edits(line: str) -> list[str]:
    """The cheapest edits that make the quoting sound, whatever the number of fields, as ``op@offset``."""
    return cheapest_edits([line])[0][2]


@F.pandas_udf(PARSED)
def error_parse(line: pd.Series, least: pd.Series, most: pd.Series) -> pd.DataFrame:
    """Edits of the cheapest parse of each line, by class, and its fields if there are none; nulls for a null line."""
    out: list[tuple] = [(None, None, None, None)] * len(line)
    for (lo, hi), rows in pd.DataFrame({"lo": least, "hi": most})[line.notna()].groupby(["lo", "hi"]).groups.items():
        texts = [line[i] for i in rows]
        for i, x, (q, d, ops) in zip(rows, texts, cheapest_edits(texts, int(lo), int(hi))):
            out[i] = (q, d, ops, None if ops else zero_cost(x))
    return pd.DataFrame(out, columns=["quoting", "columns", "edits", "fields"], dtype=object)


def _bare(c: Column) -> Column:
    """ASCII digits without leading zeros; null for anything else."""
    return F.when(c.rlike(r"\A[0-9]+\z"), F.regexp_replace(c, r"\A0+(?=[0-9])", ""))


def _more(a: Column, b: Column) -> Column:
    """The bare number ``a`` is greater than ``b``."""
    return (F.length(a) > F.length(b)) | ((F.length(a) == F.length(b)) & (a > b))


def _type_error(kind: Column, f: Column, start: Column, end: Column) -> Column:
    """The first field without its type; null if all have theirs. ``start``, ``end``: the bare second and third field."""
    bad_start = start.isNull() | _more(start, F.lit(str(MAX64))) | F.coalesce(_more(start, end), F.lit(False))
    bad_score = (F.size(f) > 4) & ~F.get(f, F.lit(4)).rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    bed = F.when(bad_start, "start").when(bad_score, "score")
    return F.when(kind == "bed", bed).when(start.isNull() | _more(start, F.lit(str(MAX32))), "count")


def parse_lines(df: DataFrame) -> DataFrame:
    """Every record line of ``df`` (line_id, record_kind, line): line_id, record_kind, reason, n_edits, edits, fields.

    ``fields`` is given for a loaded line, whose reason is null; else ``reason`` and ``edits`` (all of them, joined by
    commas) are. Lines that are no records (blank, comment, ``track``, ``browser``) and null lines give no row; so do kinds
    other than those of ``KINDS``. One carriage return at the end isn't part of a line. Very long lines are read whole.
    Repeated rows are each judged. Each row is judged alone: no shuffle, no state.
    """
    kind, x = F.col("record_kind"), F.col("line")
    rows = once(df.where(kind.isin(*KINDS) & x.isNotNull()).select("line_id", "record_kind", F.col("line").alias("_raw")), line=F.when(F.endswith("_raw", F.lit("\r")), F.left("_raw", F.length("_raw") - 1)).otherwise(F.col("_raw")))
    rows = rows.where((strip(x) != "") & ~(x.startswith("#") | x.startswith("track ") | x.startswith("browser ")))

    def per_kind(what: str) -> Column:
        out = F.lit(None).cast("int")
        for name, k in KINDS.items():
            out = F.when(kind == name, getattr(k, what)).otherwise(out)
        return out

    plain = ~F.contains(x, F.lit('"')) & F.size(F.split(x, "\t")).between(per_kind("least"), per_kind("most"))
    rows = rows.withColumn("p", error_parse(F.when(~plain, x), per_kind("least"), per_kind("most")))
    rows = once(rows, f=F.when(F.col("p.quoting").isNull(), F.transform(F.split(x, "\t"), strip)).otherwise(F.col("p.fields")), q=F.col("p.quoting"), d=F.col("p.columns"), ops=F.col("p.edits"))
    # a second field is a BED line's start and an exon line's count
    rows = once(rows, second=_bare(F.get("f", F.lit(1))), third=_bare(F.get("f", F.lit(2))))
    rows = once(rows, wrong=F.when(F.col("f").isNotNull(), _type_error(kind, F.col("f"), F.col("second"), F.col("third"))))
    reason = F.when(F.col("q") > 0, "quoting").when(F.col("d") > 0, "column_count").otherwise(F.col("wrong"))
    edits = F.when(F.col("wrong").isNotNull(), F.concat(F.lit("retype_"), "wrong")).otherwise(F.coalesce(F.array_join("ops", ","), F.lit("")))
    n = F.when(F.col("wrong").isNotNull(), 1).otherwise(F.coalesce(F.size("ops"), F.lit(0)))
    return rows.select("line_id", "record_kind", reason.alias("reason"), n.cast("int").alias("n_edits"), edits.alias("edits"), F.when(reason.isNull(), F.col("f")).alias("fields"))


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null").select("line_id", "reason")


def loaded_bed(parsed: DataFrame) -> DataFrame:
    """The loaded BED lines, typed."""
    f = "try_element_at(fields, {})"
    cols = ["fields[0] as chrom", "cast(fields[1] as bigint) as start", "try_cast(fields[2] as bigint) as end", f"{f.format(4)} as name", f"cast({f.format(5)} as double) as score", f"{f.format(6)} as strand"]
    return parsed.where("reason is null and record_kind = 'bed'").selectExpr("line_id", *cols)


def loaded_counts(parsed: DataFrame) -> DataFrame:
    """The loaded exon-count lines, typed."""
    return parsed.where("reason is null and record_kind = 'exon_counts'").selectExpr("line_id", "fields[0] as name", "cast(fields[1] as int) as count")
