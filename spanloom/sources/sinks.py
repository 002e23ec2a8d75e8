"""Formatters and sinks: each gives a ``value`` column of text lines or blocks, which ``write_text`` stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.sequence import meta_to_string


def write_text(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select("value").write.mode(mode).text(path)


def bed_line(cols: tuple[str, ...] = ("chrom", "start", "end", "name", "score", "strand")) -> Column:
    """Fields joined by tabs; absent (null) ones are left out, so later ones move left."""
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in cols])


def to_bed(df: DataFrame) -> DataFrame:
    have = tuple(c for c in ("chrom", "start", "end", "name", "score", "strand") if c in df.columns)
    return df.select(bed_line(have).alias("value"))


def fasta_record(width: int = 50, coords: bool = True) -> Column:
    """``>name:start-end (remaining) k=v...`` and the sequence in lines of ``width``."""
    head = F.concat(F.lit(">"), F.col("name"))
    if coords:
        rest = F.when(F.col("remaining").isNotNull(), F.concat(F.lit(" ("), F.col("remaining").cast("string"), F.lit(")"))).otherwise(F.lit(""))
        head = F.concat(head, F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), rest)
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(head, F.lit("\n"), body)


def to_fasta(df: DataFrame, width: int = 50, coords: bool = False, meta: str | None = None) -> DataFrame:
    rec = fasta_record(width, coords)
    if meta:
        rec = F.regexp_replace(rec, "^([^\n]*)", F.concat(F.lit("$1 "), meta_to_string(meta)))
    return df.select(rec.alias("value"))


def to_fastq(df: DataFrame) -> DataFrame:
    """Four lines a read; the name is repeated."""
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), "name"), F.col("seq"), F.concat(F.lit("+"), "name"), F.col("qual")).alias("value"))


def to_maf(blocks: DataFrame) -> DataFrame:
    """Blocks (as ``read_maf`` gives them) as MAF text, one row a block, sequences in their order."""
    neg = F.col("strand") == "-"
    total = F.col("end") + F.when(neg, F.col("start") * 0).otherwise(F.col("remaining"))
    total = F.when(neg, F.col("remaining") + (F.col("end") - F.col("start")) + F.col("start")).otherwise(total)
    start = F.when(neg, total - F.col("end")).otherwise(F.col("start"))
    size = F.col("end") - F.col("start")
    m = lambda k: F.try_element_at("meta", F.lit(k))
    seq = F.concat_ws(" ", F.when(F.col("seq").isNull(), "e").otherwise("s"), "name", start.cast("string"), size.cast("string"), "strand", total.cast("string"), F.coalesce("seq", m("empty")))
    ctx = [m(k) for k in ("left_status", "left_count", "right_status", "right_count")]
    some, every = ctx[0].isNotNull(), ctx[0].isNotNull()
    for c in ctx[1:]:
        some, every = some | c.isNotNull(), every & c.isNotNull()
    part = F.when(every, F.concat_ws(" ", F.lit("i"), "name", *ctx)).when(some, F.raise_error(F.lit("only part of a context line is known")).cast("string"))
    qual = F.when(m("quality").isNotNull(), F.concat_ws(" ", F.lit("q"), "name", m("quality")))
    rows = blocks.select("block", "block_meta", F.col("ord").alias("o"), F.concat_ws("\n", seq, part, qual).alias("t"))
    out = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("rows"), F.first("block_meta").alias("meta"))
    head = F.concat_ws(" ", F.lit("a"), F.when(F.size("meta") > 0, meta_to_string("meta")))
    return out.select(F.concat(head, F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["t"]), "\n"), F.lit("\n")).alias("value"))


def repeat_alignment_text(r: dict, width: int = 50, name_width: int = 20) -> str:
    """One repeat alignment (a row of ``read_repeat_alignments`` as a dict) in its text form."""
    comp = r["r_strand"] == "-"
    place = [f"({r['r_remaining']})", str(r["r_end"] - 1), str(r["r_start"])] if comp else [str(r["r_start"]), str(r["r_end"] - 1), f"({r['r_remaining']})"]
    meta = r["meta"] or {}
    head = [f"{r['score']:g}", *[f"{float(meta.get(k, 0)):.2f}" for k in ("substitutions", "deletions", "insertions")], r["q_name"], str(r["q_start"]), str(r["q_end"] - 1), f"({r['q_remaining']})", *(["C"] if comp else []), r["r_name"], *place]
    head += [meta["source"]] if "source" in meta else []
    head += [r["uniq_id"]] if r["uniq_id"] is not None else []
    names = [r["q_name"][:name_width], r["r_name"][:name_width]]
    w = max(map(len, names))
    digits = max(len(str(x)) for x in (r["q_end"], r["r_end"], r["q_start"], r["r_start"]))
    out, a, b = [" ".join(head), ""], r["q_start"], (r["r_end"] - 1 if comp else r["r_start"])
    for i in range(0, len(r["q_seq"]), width):
        q, s, m = r["q_seq"][i : i + width], r["r_seq"][i : i + width], r["annotation"][i : i + width]
        na, nb = len(q.replace("-", "")), len(s.replace("-", ""))
        a2, b2 = a + max(na - 1, 0), b - max(nb - 1, 0) if comp else b + max(nb - 1, 0)
        out.append(f"  {names[0]:<{w}} {a:>{digits}} {q} {a2}")
        out.append(" " * (4 + w + digits) + m.rstrip())
        out.append(f"{'C' if comp else ' '} {names[1]:<{w}} {b:>{digits}} {s} {b2}")
        out.append("")
        a, b = a + na, b - nb if comp else b + nb
    return "\n".join([*out, *[f"{k} = {v}" for k, v in meta.items() if k not in ("substitutions", "deletions", "insertions", "source")], ""])


def to_repeat_alignments(df: DataFrame, width: int = 50, name_width: int = 20) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([repeat_alignment_text({**r, "meta": dict(r["meta"] or {})}, width, name_width) for r in b.to_pylist()], pa.string())], ["value"])

    return df.mapInArrow(run, "value string")


def occurrence_text() -> Column:
    """A repeat occurrence: its place as BED, an arrow, and its place on the consensus, named ``family#name``."""
    return F.concat(bed_line(("chrom", "start", "end", "name", "score", "strand")), F.lit(" --> "), F.concat_ws("\t", "family", F.col("c_start").cast("string"), F.col("c_end").cast("string"), F.col("c_len").cast("string")))


def write_table(df: DataFrame, path: str, header: bool = True, sep: str = "\t", mode: str = "error") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).option("quote", "").option("emptyValue", "").csv(path)
