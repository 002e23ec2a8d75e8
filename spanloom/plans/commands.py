"""Every command of the command line over files made of the driver's tables, its output read back.

The commands run in this session; their files go to the folder all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.common import fresh, table
from spanloom.plans import reference
from spanloom.plans import views as v
from spanloom.plans.views import with_
from spanloom.sources import sinks, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _bed(spark: SparkSession, df: DataFrame) -> str:
    at = fresh(spark, "bed")
    sinks.write_text(sinks.to_bed(df), at)
    return at


def _text(spark: SparkSession, df: DataFrame) -> str:
    at = fresh(spark, "text")
    sinks.write_text(df, at)
    return at


def _table(spark: SparkSession, df: DataFrame, header: bool = True) -> str:
    at = fresh(spark, "table")
    sinks.write_table(df, at, header)
    return at


def _ran(spark: SparkSession, *args: str) -> str:
    at = fresh(spark, "out")
    cli.main([*args, "-o", at])
    return at


@query("select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment, cast(o_orderkey as varchar) as o_orderkey, o_orderstatus from customer join orders on c_custkey = o_custkey")
def c01_join(spark, d):
    a = _table(spark, table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))
    b = _table(spark, table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"))
    return text.read_table(spark, _ran(spark, "join", a, b, "-a", "c_custkey", "-b", "o_custkey", "-d", "all_pairwise_combinations")).drop("ord")


@query("""select 'NA' || chr(9) || 'NA' || chr(9) || 'o_orderkey' as line union all
select c_custkey || chr(9) || coalesce(nullif(trim(c_mktsegment), ''), 'NA') || chr(9) || o_orderkey from customer join orders on c_custkey = o_custkey""")
def c01_join_mixed_headers(spark, d):
    a = _table(spark, table(spark, d, "customer").select("c_custkey", "c_mktsegment"), header=False)
    b = _table(spark, table(spark, d, "orders").select("o_custkey", "o_orderkey"))
    out = _ran(spark, "join", a, b, "-a", "1", "-b", "o_custkey", "-d", "all_pairwise_combinations", "-m", "NA")
    return spark.read.text(out).select(F.col("value").alias("line"))


@query(reference.SQL["i01_collapse"])
def c02_region_collapse(spark, d):
    return text.read_bed(spark, _ran(spark, "regionCollapse", _bed(spark, v.reads(spark, d))))


@query(reference.SQL["a01_read_counts"].replace("count(a.name) as score", "cast(count(a.name) as double) as score"))
def c03_read_counts(spark, d):
    return text.read_bed(spark, _ran(spark, "readCounts", _bed(spark, v.regions(spark, d)), _bed(spark, v.reads(spark, d))), "double").select("chrom", "start", "end", "name", "strand", "score")


_EXON = "'^(.*)_exon_([0-9]+)_0_(.*)_([0-9]+)_([fr])$'"


@query(f"""with e as (select regexp_extract(trim(name), {_EXON}, 1) as gene, regexp_extract(trim(name), {_EXON}, 3) as chrom, cast(regexp_extract(trim(name), {_EXON}, 4) as bigint) as loc,
case when regexp_extract(trim(name), {_EXON}, 5) = 'r' then '-' else '+' end as strand, "count" as n from exon_counts where regexp_matches(trim(name), {_EXON}) and "count" is not null),
g as (select gene_id, trim(chrom) as chrom, "start", "end", trim(name) as name, trim(strand) as strand from genes where trim(chrom) <> '' and trim(name) <> '' and trim(strand) in ('+', '-') and "start" is not null and "end" is not null)
select g.chrom, g."start", g."end", g.name, cast(coalesce(sum(n), 0) as bigint) as score, g.strand from g left join e on e.gene = g.name and e.chrom = g.chrom and e.strand = g.strand and e.loc between g."start" and g."end" group by gene_id, g.chrom, g."start", g."end", g.name, g.strand""")
def c04_exon_to_gene(spark, d):
    good = F.trim("name").rlike(r"^(.*)_exon_(\d+)_0_(.*)_(\d+)_([fr])$")
    counts = table(spark, d, "exon_counts").where(good & F.col("count").isNotNull()).select(F.concat_ws("\t", "name", F.col("count").cast("string")).alias("value"))
    genes = table(spark, d, "genes").where("trim(chrom) <> '' and trim(name) <> '' and trim(strand) in ('+', '-') and start is not null and end is not null")
    genes = genes.select("chrom", "start", "end", "name", F.lit(0).alias("score"), "strand")
    return text.read_bed(spark, _ran(spark, "exonToGeneReadCounts", _text(spark, counts), "-r", _bed(spark, genes)))


@query(reference._SIDES + " select coalesce(x.side, y.side) as side, coalesce(x.name, y.name) as name, coalesce(x.score, y.score) as score from x full join y on x.name = y.name and x.o = y.o where x.side is null or y.side is null")
def c05_remove_duplicates(spark, d):
    sides = [s.select(F.lit("c").alias("chrom"), F.lit(1).alias("start"), F.lit(2).alias("end"), "name", "score", F.lit("+").alias("strand")) for s in reference._sides(spark, d)]
    one, two = fresh(spark, "out"), fresh(spark, "out")
    cli.main(["remDupsBED", _bed(spark, sides[0]), _bed(spark, sides[1]), "-f", one, "-s", two])
    read = lambda p, i: text.read_bed(spark, p).select(F.lit(i).alias("side"), "name", "score")
    return read(one, 1).unionByName(read(two, 2))


@query(reference.SQL["s14_junctions_both"])
def c06_convert_junctions(spark, d):
    return text.read_bed(spark, _ran(spark, "convertJunctionReads", _bed(spark, v.junctions(spark, d)), "-s", "BOTH"))


@query(reference.SQL["a03_profile_start"])
def c07_overlap_profile(spark, d):
    out = text.read_table(spark, _ran(spark, "overlapProfile", _bed(spark, v.regions(spark, d)), _bed(spark, v.reads(spark, d)), "-n"), header=False)
    return out.select(F.col("c1").cast("long").alias("pos"), F.round(F.col("c2").cast("double"), 9).alias("value"))


def _maf(spark: SparkSession, d: str) -> str:
    rows = v.blocks(spark, d).withColumns({"ord": (F.col("name") != "A.chr1").cast("int"), "remaining": F.lit(1000).cast("long"), "meta": F.create_map().cast("map<string,string>"), "block_meta": F.create_map(F.lit("score"), F.col("block").cast("string"))})
    return _text(spark, sinks.to_maf(rows))


@query(f"select pid from ({reference.SQL['a04_conservation_profile']})")
def c08_conservation_profile(spark, d):
    r = table(spark, d, "orders").selectExpr("'chr1' as chrom", "o_orderkey * 997 as start", "o_orderkey * 997 + 40 as end", "concat('r', o_orderkey) as name", "0 as score", "if(o_orderkey % 2 = 0, '+', '-') as strand")
    out = _ran(spark, "consprofile", _maf(spark, d), _bed(spark, r), "-w", "40", "-f", "A", "-m")
    return spark.read.text(out).select(F.round(F.col("value").cast("double"), 9).alias("pid"))


@query(f"{with_('seqs', 'blocks')}, k as (select min(block) as block from blocks where name = 'A.chr1' and \"start\" < \"end\") select name, seq, \"start\", \"end\" from blocks join k using (block)")
def c09_index(spark, d):
    at, first = fresh(spark, "index"), v.blocks(spark, d).where("name = 'A.chr1' and start < end").orderBy("block").first()
    cli.main(["indexBuild", _maf(spark, d), "-t", "genome", "-f", "A", "-o", at])
    out = _ran(spark, "indexLookup", at, "-k", f"chr1 {first.start} {first.end}")
    return spark.read.text(out).select(F.from_json("value", "name string, seq string, start long, end long").alias("x")).select("x.*")


@query("""with p as (select o_orderkey, ((o_orderkey * 7919) % 100003 + 1) / 100004.0 as p from orders), r as (select *, row_number() over (order by p, o_orderkey) as rn, count(*) over () as n from p)
select cast(o_orderkey as varchar) as o_orderkey, round(least(1.0, min(p * n / rn) over (order by rn desc rows unbounded preceding)), 9) as p from r""")
def c10_fdr(spark, d):
    at = _table(spark, v.pvals(spark, d).select("o_orderkey", "p"))
    return text.read_table(spark, _ran(spark, "fdr", at, "-f", "2", "-e")).select("o_orderkey", F.round(F.col("p").cast("double"), 9).alias("p"))


@query(reference.SQL["i05_intersection"])
def c11_intersection(spark, d):
    return text.read_bed(spark, _ran(spark, "genomicIntersection", _bed(spark, v.reads(spark, d)), _bed(spark, v.regions(spark, d))))


@query(f"select jaccard from ({reference.SQL['i06_jaccard']})")
def c12_jaccard(spark, d):
    out = _ran(spark, "genomicIntJaccard", _bed(spark, v.reads(spark, d)), _bed(spark, v.regions(spark, d)))
    return spark.read.text(out).select(F.round(F.col("value").cast("double"), 9).alias("jaccard"))


@query(reference.SQL["a02_nucleotide_distribution"])
def c13_nucleotide_distribution(spark, d):
    out = text.read_table(spark, _ran(spark, "fastqNucDist", _text(spark, sinks.to_fastq(v.fastq(spark, d)))), header=False)
    return out.select(F.col("c1").cast("int").alias("pos"), F.col("c2").alias("nuc"), F.col("c3").cast("long").alias("n"))
