"""Command line: each command reads text files, runs one operator and writes text (``python -m spanloom.cli COMMAND ...``).

Output goes to a directory of part files (``-o``), as Spark writes it, or to standard output.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session() -> SparkSession:
    return SparkSession.builder.appName("spanloom").getOrCreate()


def emit(df: DataFrame, out: str | None) -> None:
    """``df`` has a ``value`` column of lines."""
    if out:
        df.select("value").write.mode("error").text(out)
    else:
        for r in df.select("value").toLocalIterator():
            print(r.value)


def _lines(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.select(F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value"))


def _ordered_bed(df: DataFrame) -> DataFrame:
    from spanloom.sources.sinks import to_bed

    return to_bed(df.orderBy("chrom", "start", "end"))


def _key(x: str) -> tuple[str, bool]:
    """A number says the column and that there is no header; anything else is a column's name."""
    return (f"c{int(x)}", False) if x.isdigit() else (x, True)


def join(a: argparse.Namespace) -> None:
    from spanloom.operators.keyjoin import join_tables, joined_header
    from spanloom.sources.text import read_table

    s = session()
    (ka, ha), (kb, hb) = _key(a.first_key), _key(a.second_key or a.first_key)
    if ha != hb and a.missing is None:
        sys.exit("one table with and one without a header need a missing value")
    left, right = read_table(s, a.first, ha), read_table(s, a.second, hb)
    if a.duplicates == "column_wise_join":
        out = join_tables(left.withColumnRenamed("ord", "_o1"), right.withColumnRenamed("ord", "_o2"), ka, kb, a.duplicates, a.missing, a.ignore_missing, a.unpaired, "_o1", "_o2", ha)
    else:
        # the first table's order, then the second's; rows that only the second has come last
        place = lambda n: F.lpad(F.col("ord").cast("string"), 20, "0").alias(n)
        left, right = left.select(*[f"`{c}`" for c in left.columns if c != "ord"], place("_o1")), right.select(*[f"`{c}`" for c in right.columns if c != "ord"], place("_o2"))
        out = join_tables(left, right, ka, kb, a.duplicates, a.missing, a.ignore_missing, a.unpaired)
        out = out.orderBy(F.col("_o1").rlike("^[0-9]{20}$").desc(), "_o1", "_o2").drop("_o1", "_o2")
    lines = _lines(out)
    n = len([c for c in left.columns if c not in ("ord", "_o1")])
    head = joined_header(out.columns[:n] if ha else None, out.columns[n:] if hb else None, n, len(out.columns) - n, a.missing)
    if head:
        lines = s.createDataFrame([("\t".join(head),)], "value string").union(lines)
    emit(lines, a.output)


def region_collapse(a: argparse.Namespace) -> None:
    from spanloom.operators import setops
    from spanloom.sources.text import read_bed

    df = read_bed(session(), a.input)
    if a.exact:
        out = setops.collapse_exact(df.withColumn("_o", F.monotonically_increasing_id()), "_o", a.stranded, a.accumulate_names)
    else:
        out = setops.collapse_names(df, a.stranded) if a.accumulate_names else setops.collapse(df, a.stranded)
    emit(_ordered_bed(out), a.output)


def read_counts(a: argparse.Namespace) -> None:
    from spanloom.operators.profile import read_counts as count
    from spanloom.sources.text import read_bed

    s = session()
    emit(_ordered_bed(count(read_bed(s, a.regions, "double"), read_bed(s, a.reads, "double"))), a.output)


def exon_to_gene(a: argparse.Namespace) -> None:
    from spanloom.operators.exons import exons_to_genes, parse_exons
    from spanloom.sources.text import read_bed, read_exon_counts

    s = session()
    emit(_ordered_bed(exons_to_genes(read_bed(s, a.reference, "double"), parse_exons(read_exon_counts(s, a.input)))), a.output)


def remove_duplicates(a: argparse.Namespace) -> None:
    from spanloom.operators.paired import remove_duplicates as remove
    from spanloom.sources.sinks import to_bed
    from spanloom.sources.text import read_bed

    s = session()
    one, two = remove(read_bed(s, a.first, drop_after=6), read_bed(s, a.second, drop_after=6), a.best)
    emit(to_bed(one), a.first_output)
    emit(to_bed(two), a.second_output)


def convert_junctions(a: argparse.Namespace) -> None:
    from spanloom.operators.exons import junctions_to_exons
    from spanloom.sources.sinks import to_bed
    from spanloom.sources.text import read_bed

    emit(to_bed(junctions_to_exons(read_bed(session(), a.input), a.scheme)), a.output)


def overlap_profile(a: argparse.Namespace) -> None:
    from spanloom.operators.profile import overlap_profile as run
    from spanloom.sources.text import read_bed

    s = session()
    emit(_lines(run(read_bed(s, a.regions, "double"), read_bed(s, a.hits, "double"), a.anchor, a.normalize).orderBy("pos")), a.output)


def conservation_profile(a: argparse.Namespace) -> None:
    from spanloom.operators import alignment
    from spanloom.sources.blocks import read_maf
    from spanloom.sources.text import read_bed

    s = session()
    at = a.alignment if not a.extensions else [f"{a.alignment}/*.{e.lstrip('.')}" for e in a.extensions.split(",")]
    out = alignment.conservation_profile(read_bed(s, a.regions, "double"), read_maf(s, at), a.reference, a.window, alignment.GAPS if a.missing_as_gaps else alignment.SKIP, a.species.split(",") if a.species else None)
    emit(out.orderBy("offset").select(F.col("pid").cast("string").alias("value")), a.output)


def index_build(a: argparse.Namespace) -> None:
    """A sorted, partitioned Parquet copy stands for a byte-offset index: lookups prune files and row groups."""
    from spanloom.operators.alignment import genome_blocks
    from spanloom.sources.blocks import read_maf, read_repeat_alignments

    s = session()
    if a.type == "genome":
        rows = read_maf(s, a.input)
        place = genome_blocks(rows, a.reference).select("block", "chrom", F.col("start").alias("ref_start"), F.col("end").alias("ref_end"))
        rows.join(place, "block").repartition("chrom").sortWithinPartitions("ref_start").write.partitionBy("chrom").parquet(a.output)
    else:
        read_repeat_alignments(s, a.input).repartitionByRange("uniq_id").sortWithinPartitions("uniq_id").write.parquet(a.output)


def index_lookup(a: argparse.Namespace) -> None:
    s = session()
    rows = s.read.parquet(a.input)
    parts = a.key.split()
    hit = rows.where((F.col("chrom") == parts[0]) & (F.col("ref_start") == int(parts[1])) & (F.col("ref_end") == int(parts[2]))) if "chrom" in rows.columns else rows.where(F.col("uniq_id") == a.key)
    emit(hit.select(F.to_json(F.struct(*hit.columns)).alias("value")), a.output)


def fdr(a: argparse.Namespace) -> None:
    from spanloom.functions.stats import correct_pvalues
    from spanloom.sources.text import read_table

    s = session()
    df = read_table(s, a.input, a.header)
    cols = [c for c in df.columns if c != "ord"]
    c = cols[a.field - 1]
    out = correct_pvalues(df.withColumn("_p", F.col(f"`{c}`").cast("double")), "_p", "_q").withColumn(c, F.col("_q")).orderBy("ord").select(*[f"`{x}`" for x in cols])
    lines = _lines(out)
    emit(s.createDataFrame([("\t".join(cols),)], "value string").union(lines) if a.header else lines, a.output)


def intersection(a: argparse.Namespace) -> None:
    from spanloom.operators.setops import intersection as run
    from spanloom.sources.text import read_bed

    s = session()
    sides = [read_bed(s, p, "double").withColumn("strand", F.coalesce("strand", F.lit("+"))) for p in (a.first, a.second)]
    emit(_ordered_bed(run(*sides)), a.output)


def jaccard(a: argparse.Namespace) -> None:
    from spanloom.operators.setops import jaccard as run
    from spanloom.sources.text import read_bed

    s = session()
    sides = [read_bed(s, p, "double").withColumn("strand", F.coalesce("strand", F.lit("+"))) for p in (a.first, a.second)]
    emit(run(*sides).select(F.col("jaccard").cast("string").alias("value")), a.output)


def nucleotide_distribution(a: argparse.Namespace) -> None:
    from spanloom.operators.profile import nucleotide_distribution as run
    from spanloom.sources.blocks import read_fastq

    emit(_lines(run(read_fastq(session(), a.input, allow_mismatch=True)).orderBy("pos", "nuc")), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *options: tuple, out: bool = True) -> None:
        c = sub.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for names, kw in options:
            c.add_argument(*names, **kw)
        if out:
            c.add_argument("-o", "--output")
        c.set_defaults(run=run)

    flag = {"action": "store_true"}
    one = (("input",), {})
    both = ((("first",), {}), (("second",), {}))
    command("join", join, *both, (("-a", "--first-key"), {"default": "1"}), (("-b", "--second-key"), {}), (("-m", "--missing"), {}), (("-d", "--duplicates"), {"default": "error_on_dups"}), (("-i", "--ignore-missing"), flag), (("-p", "--unpaired"), flag))
    command("regionCollapse", region_collapse, one, (("-s", "--stranded"), flag), (("-a", "--accumulate-names"), flag), (("-e", "--exact"), flag))
    command("readCounts", read_counts, (("regions",), {}), (("reads",), {}))
    command("exonToGeneReadCounts", exon_to_gene, one, (("-r", "--reference"), {"required": True}))
    command("remDupsBED", remove_duplicates, *both, (("-f", "--first-output"), {}), (("-s", "--second-output"), {}), (("-b", "--best"), flag), out=False)
    command("convertJunctionReads", convert_junctions, one, (("-s", "--scheme"), {"default": "BOTH"}))
    command("overlapProfile", overlap_profile, (("regions",), {}), (("hits",), {}), (("-a", "--anchor"), {"default": "START"}), (("-n", "--normalize"), flag))
    command("consprofile", conservation_profile, (("alignment",), {}), (("regions",), {}), (("-w", "--window"), {"type": int, "default": 100}), (("-e", "--extensions"), {}), (("-f", "--reference"), {"required": True}), (("-m", "--missing-as-gaps"), flag), (("-s", "--species"), {}))
    command("indexBuild", index_build, one, (("-t", "--type"), {"choices": ["genome", "repeats"], "default": "genome"}), (("-f", "--reference"), {}))
    command("indexLookup", index_lookup, one, (("-k", "--key"), {"required": True}))
    command("fdr", fdr, one, (("-f", "--field"), {"type": int, "default": 4}), (("-e", "--header"), flag))
    command("genomicIntersection", intersection, *both)
    command("genomicIntJaccard", jaccard, *both)
    command("fastqNucDist", nucleotide_distribution, one)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    a.run(a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
