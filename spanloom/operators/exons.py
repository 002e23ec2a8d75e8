"""Exon counts summed over genes, and junction reads split into their exons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.predicates import is_positive

#: Fixed value: the form of an exon's name; the chromosome may hold underscores.
EXON = r"^(.*)_exon_(\d+)_0_(.*)_(\d+)_([fr])$"
#: Fixed value: a junction's chromosome field, with the two exons' places.
JUNCTION = r"^(.*)_(\d+)_(\d+)_(\d+)_(\d+)$"
SCHEMES = ("FIRST", "SECOND", "BOTH", "BIGGEST", "FIVE_PRIME_END")


def parse_exons(df: DataFrame, name: str = "name", count: str = "count", strict: bool = True) -> DataFrame:
    """gene, exon_no, chrom, loc, strand, count of exon names; another form fails, or is left out unless ``strict``."""
    part = lambda i: F.regexp_extract(F.col(name), EXON, i)
    good = F.col(name).rlike(EXON)
    rows = df.where(F.col(name).isNotNull())
    rows = rows.withColumn("_ok", F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("not an exon name: "), F.col(name))).cast("boolean") if strict else F.lit(False))).where("_ok")
    return rows.select(part(1).alias("gene"), part(2).cast("int").alias("exon_no"), part(3).alias("chrom"), part(4).cast("long").alias("loc"), F.when(part(5) == "r", "-").otherwise("+").alias("strand"), F.col(count).alias("count"))


def exons_to_genes(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """``genes`` (chrom, start, end, name, strand) with the summed counts of their exons as score; 0 where none.

    An exon belongs to a gene of its name, chrom and strand if its place lies in [start, end], both ends included.
    Counts are summed per place before the join and per gene row after it; equal gene rows stay apart.
    """
    at = exons.groupBy(F.col("gene").alias("_name"), F.col("chrom").alias("_chrom"), F.col("strand").alias("_strand"), "loc").agg(F.sum("count").alias("n"))
    cols = [c for c in genes.columns if c != "score"]
    keyed = genes.groupBy(*cols).agg(F.count("*").cast("int").alias("_copies"))
    on = (F.col("name") == F.col("_name")) & (F.col("chrom") == F.col("_chrom")) & (F.col("strand") == F.col("_strand")) & F.col("loc").between(F.col("start"), F.col("end"))
    out = keyed.join(at, on, "left").groupBy(*cols, "_copies").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("score"))
    return out.withColumn("_c", F.explode(F.sequence(F.lit(1), "_copies"))).select(*cols, "score")


def _exon(chrom: Column, start: Column, end: Column, tag: str) -> Column:
    return F.struct(chrom.alias("chrom"), start.alias("start"), end.alias("end"), F.concat("name", F.lit(tag)).alias("name"), F.col("score"), F.col("strand"))


def junctions_to_exons(reads: DataFrame, scheme: str = "BOTH") -> DataFrame:
    """Reads on junction chromosomes (``chrom_s1_e1_s2_e2``) as reads on their exons, by ``scheme``.

    The first exon's part is [s1 + start - 1, e1), the second's [s2, s2 + (end - (e1 - s1)) - 1). BIGGEST takes the
    longer (the first of equal ones); FIVE_PRIME_END the first on + and where no strand is given, the second on -.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme}; one of {', '.join(SCHEMES)}")
    p = [F.regexp_extract("chrom", JUNCTION, i) for i in range(1, 6)]
    ok = F.when(F.col("chrom").rlike(JUNCTION), True).otherwise(F.raise_error(F.concat(F.lit("not a junction: "), F.coalesce("chrom", F.lit("null")))).cast("boolean"))
    s1, e1, s2 = p[1].try_cast("long"), p[2].try_cast("long"), p[3].try_cast("long")
    first = _exon(p[0], s1 + F.col("start") - 1, e1, "%1")
    second = _exon(p[0], s2, s2 + (F.col("end") - (e1 - s1)) - 1, "%2")
    rows = reads.where(ok).select("strand", first.alias("x"), second.alias("y"))
    size = lambda c: F.col(f"{c}.end") - F.col(f"{c}.start")
    pick = {
        "FIRST": F.array("x"),
        "SECOND": F.array("y"),
        "BOTH": F.array("x", "y"),
        "BIGGEST": F.when(size("x") >= size("y"), F.array("x")).otherwise(F.array("y")),
        "FIVE_PRIME_END": F.when(is_positive(F.col("strand")), F.array("x")).otherwise(F.array("y")),
    }[scheme]
    return rows.select(F.explode(pick).alias("e")).select("e.*")
