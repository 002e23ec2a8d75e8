"""Round trips through the text formats: the driver's tables written by a sink and read back by the reader.

Files go to the folder all executors share (``spark.checkpoint.dir``), as the readers must see what other executors wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.common import fresh, table
from spanloom.functions.sequence import meta_to_string
from spanloom.operators.liftover import repeat_name
from spanloom.plans import views as v
from spanloom.plans.views import with_
from spanloom.sources import blocks, sinks, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _stored(spark: SparkSession, df: DataFrame, kind: str) -> str:
    at = fresh(spark, kind)
    sinks.write_text(df, at)
    return at


@query(f'{with_("rois")} select chrom, "start", "end", name, score, strand from rois')
def sc01_bed(spark, d):
    return text.read_bed(spark, _stored(spark, sinks.to_bed(v.regions(spark, d)), "bed"))


@query(f'{with_("wig")} select chrom, "start", "end", score from wig')
def sc04_wig(spark, d):
    lines = v.wig(spark, d).select(F.concat_ws("\t", "chrom", "start", "end", F.col("score").cast("string")).alias("value"))
    return text.read_wig(spark, _stored(spark, lines, "wig"))


@query("""with n as (select p_brand as chrom, row_number() over (partition by p_brand order by p_partkey) - 1 as i, p_retailprice as score from part)
select chrom, 100 + i * 10 as "start", 110 + i * 10 as "end", score from n""")
def sc06_fixed_wig(spark, d):
    per = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice"))).alias("x"))
    lines = per.select(F.concat(F.lit("fixedStep chrom="), "p_brand", F.lit(" start=100 step=10\n"), F.array_join(F.transform("x", lambda r: r["p_retailprice"].cast("string")), "\n")).alias("value"))
    return blocks.read_fixed_wig(spark, _stored(spark, lines, "fixed"))


@query(f"{with_('seqs')} select name, seq from seqs")
def sc07_fasta(spark, d):
    return blocks.read_fasta(spark, _stored(spark, sinks.to_fasta(v.seqs(spark, d)), "fasta"))


@query(f"{with_('seqs')} select name, seq, translate(seq, 'ACGTN', 'IHGF#') as qual from seqs")
def sc09_fastq(spark, d):
    return blocks.read_fastq(spark, _stored(spark, sinks.to_fastq(v.fastq(spark, d)), "fastq"))


@query(f'{with_("seqs", "blocks")} select name, seq, "start", "end", strand from blocks')
def sc12_maf(spark, d):
    rows = v.blocks(spark, d).withColumns({"ord": (F.col("name") != "A.chr1").cast("int"), "remaining": F.lit(1000).cast("long"), "meta": F.create_map().cast("map<string,string>"), "block_meta": F.create_map(F.lit("score"), F.col("block").cast("string"))})
    return blocks.read_maf(spark, _stored(spark, sinks.to_maf(rows), "maf")).select("name", "seq", "start", "end", "strand")


@query("select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderstatus from orders")
def sc20_table(spark, d):
    at = fresh(spark, "table")
    sinks.write_table(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(3), at)
    return text.read_table(spark, at).drop("ord")


@query("""select trim(name) as name, cast("count" as bigint) as "count" from exon_counts where name is not null and "count" is not null""")
def sc22_exon_counts(spark, d):
    lines = table(spark, d, "exon_counts").where("name is not null and count is not null").select(F.concat_ws("\t", "name", F.col("count").cast("string")).alias("value"))
    return text.read_exon_counts(spark, _stored(spark, lines, "exons"))


@query(f'{with_("wig")}, n as (select p_brand as chrom, row_number() over (partition by p_brand order by p_partkey) - 1 as i, p_retailprice as score from part) select chrom, "start", "end", score from wig union all select chrom, 100 + i * 10, 110 + i * 10, score from n')
def sc03_wig_any(spark, d):
    per = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_retailprice"))).alias("x"))
    fixed = per.select(F.concat(F.lit("fixedStep chrom="), "p_brand", F.lit(" start=100 step=10\n"), F.array_join(F.transform("x", lambda r: r["p_retailprice"].cast("string")), "\n")).alias("value"))
    lines = v.wig(spark, d).select(F.concat_ws("\t", "chrom", "start", "end", F.col("score").cast("string")).alias("value"))
    return text.read_wig_any(spark, [_stored(spark, fixed, "fixed"), _stored(spark, lines, "wig")])


@query(f"{with_('seqs')} select count(*) as n from seqs")
def sc08_num_sequences(spark, d):
    return spark.range(1).select(F.lit(blocks.count_sequences(spark, _stored(spark, sinks.to_fasta(v.seqs(spark, d)), "fasta"))).cast("long").alias("n"))


@query(f"{with_('seqs')} select name, seq, translate(seq, 'ACGTN', 'IHGF#') as qual from seqs")
def sc11_wrapped_fastq(spark, d):
    wrap = lambda c: F.regexp_replace(c, "(.{60})(?=.)", "$1\n")
    rec = v.fastq(spark, d).select(F.concat(F.lit("@"), "name", F.lit("\n"), wrap("seq"), F.lit("\n+\n"), wrap("qual")).alias("value"))
    return blocks.read_fastq(spark, _stored(spark, rec, "wrapped"), wrapped=True)


@query(f"""{with_("seqs", "blocks")} select name, case when name = 'A.chr1' or block % 5 <> 0 then seq end as seq, "start", "end", strand,
case when name = 'A.chr1' then 'left_count=3 left_status=C quality=' || repeat('9', length(seq)) || ' right_count=0 right_status=N' when block % 5 = 0 then 'empty=I' else '' end as meta, block as score from blocks""")
def sc12_maf_lines(spark, d):
    """All line types: context, quality and empty ones."""
    first, empty = F.col("name") == "A.chr1", (F.col("name") != "A.chr1") & (F.col("block") % 5 == 0)
    meta = F.when(first, F.create_map(*[F.lit(x) for x in ("left_status", "C", "left_count", "3", "right_status", "N", "right_count", "0", "quality")], F.repeat(F.lit("9"), F.length("seq")))).when(empty, F.create_map(F.lit("empty"), F.lit("I"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = v.blocks(spark, d).withColumns({"ord": (~first).cast("int"), "remaining": F.lit(1000).cast("long"), "meta": meta, "block_meta": F.create_map(F.lit("score"), F.col("block").cast("string"))}).withColumn("seq", F.when(~empty, F.col("seq")))
    got = blocks.read_maf(spark, _stored(spark, sinks.to_maf(rows), "maf"))
    return got.select("name", "seq", "start", "end", "strand", meta_to_string("meta").alias("meta"), F.col("block_meta")["score"].cast("long").alias("score"))


def _maf(spark: SparkSession, d: str, rows: DataFrame, at: str) -> str:
    rows = rows.withColumns({"ord": (F.col("name") != "A.chr1").cast("int"), "remaining": F.lit(1000).cast("long"), "meta": F.create_map().cast("map<string,string>"), "block_meta": F.create_map(F.lit("score"), F.col("block").cast("string"))})
    sinks.write_text(sinks.to_maf(rows), at)
    return at


@query(f"""{with_("seqs", "blocks")} select b.name, 'chr1' as ref_chrom, a."start" as ref_start, a."end" as ref_end, b.seq from blocks b join blocks a on a.block = b.block and a.name = 'A.chr1'""")
def sc14_genome_alignment(spark, d):
    at = fresh(spark, "genome")
    _maf(spark, d, v.blocks(spark, d), f"{at}/all.maf")
    return blocks.genome_alignment(spark, at, "A", ["maf"]).select("name", "ref_chrom", "ref_start", "ref_end", "seq")


@query(f"""{with_("seqs", "blocks")} select name, seq from blocks where block % 2 = 0""")
def sc15_locus_files(spark, d):
    at = fresh(spark, "loci")
    files = [_maf(spark, d, v.blocks(spark, d).where(f"block % 2 = {i}"), f"{at}/chr{i + 1}.maf") for i in (0, 1)]
    return blocks.read_locus_alignment(spark, files, "chr1", 0, 10, ["maf"]).select("name", "seq")


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    o = v.occurrences(spark, d).where("start < end").withColumn("id", F.concat("name", F.lit("_"), "start"))
    left, neg = F.concat(F.lit("("), (F.col("c_len") - F.col("c_end")).cast("string"), F.lit(")")), F.col("strand") == "-"
    place = F.when(neg, F.concat_ws("  ", left, (F.col("c_end") - 1).cast("string"), F.col("c_start").cast("string"))).otherwise(F.concat_ws(" ", F.col("c_start").cast("string"), (F.col("c_end") - 1).cast("string"), left))
    line = F.concat_ws("  ", F.lit("  463 1.3 0.6 1.7"), "chrom", F.col("start").cast("string"), (F.col("end") - 1).cast("string"), F.lit("(77)"), F.when(neg, "C").otherwise("+"), "name", F.lit("Simple"), place, "id")
    return o.select(line.alias("value"))


@query(f'{with_("rois", "occ")} select chrom, "start", "end", strand, cast(463 as double) as score, name, \'Simple\' as family, c_start, c_end, c_len, name || \'_\' || "start" as uniq_id from occ where "start" < "end"')
def sc16_repeat_annotations(spark, d):
    return text.read_repeats(spark, _stored(spark, _annotations(spark, d), "repeats"))


@query(f"""{with_("seqs", "blocks")}, a as (select block as uniq_id, seq as q_seq, "start" as q_start, "end" as q_end from blocks where name = 'A.chr1'), b as (select block as uniq_id, seq as r_seq, "start" as r_start, "end" as r_end, strand as r_strand from blocks where name = 'B.chr1')
select cast(uniq_id as varchar) as uniq_id, q_seq, q_start, q_end, r_seq, r_start, r_end, r_strand, rpad('', cast(length(q_seq) as int), ' ') as annotation from a join b using (uniq_id)""")
def sc18_repeat_alignments(spark, d):
    rows = _alignments(spark, d)
    return blocks.read_repeat_alignments(spark, _stored(spark, sinks.to_repeat_alignments(rows), "alignments")).select("uniq_id", "q_seq", "q_start", "q_end", "r_seq", "r_start", "r_end", "r_strand", "annotation")


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    from spanloom.plans.reference import _repeat_rows

    rows = _repeat_rows(spark, d).withColumns({"score": F.lit(7.0), "q_name": F.lit("chr1"), "r_name": F.lit("L1#fam"), "q_remaining": F.lit(5).cast("long"), "r_remaining": F.lit(6).cast("long"), "annotation": F.repeat(F.lit(" "), F.length("q_seq")), "meta": F.create_map(F.lit("source"), F.lit("m"), F.lit("Matrix"), F.lit("25p41g"))})
    return rows.select(*[c.strip().split(" ")[0] for c in blocks.REPEATS.replace("map<string,string>", "map").split(",")])


@query(f"""{with_("seqs", "blocks")}, a as (select block as uniq_id, seq from blocks where name = 'A.chr1'), o as (select cast(o_orderkey as varchar) as uniq_id from orders)
select o.uniq_id, a.seq as q_seq, case when a.seq is not null then true end as named from o left join a on o.uniq_id = cast(a.uniq_id as varchar)""")
def sc17_annotations_with_alignments(spark, d):
    lines = table(spark, d, "orders").select(F.concat(F.lit("463 1.3 0.6 1.7 chr1 10 20 (77) + L1#family Simple 1 11 (0) "), F.col("o_orderkey").cast("string")).alias("value"))
    got = text.with_alignments(text.read_repeats(spark, _stored(spark, lines, "repeats")), _alignments(spark, d))
    return got.select("uniq_id", F.col("alignment.q_seq").alias("q_seq"), text.names_match(F.col("name"), F.col("alignment.r_name")).alias("named"))


@query("select p_type as category, 'GO:' || p_partkey as identifier, p_name as name, round(p_retailprice / 1000, 6) as pvalue from part")
def sc19_enrichment(spark, d):
    head = spark.createDataFrame([("\t".join(["Category", "Term", *[f"x{i}" for i in range(11)]]),)], "value string").coalesce(1)
    p = table(spark, d, "part")
    fields = [F.col("p_type"), F.concat(F.lit("GO:"), F.col("p_partkey").cast("string"), F.lit("~"), F.col("p_name")), *[F.lit(str(i)) for i in range(9)], F.round(F.col("p_retailprice") / 1000, 6).cast("string"), F.lit("0.5")]
    got = text.read_enrichment(spark, _stored(spark, head.union(p.select(F.concat_ws("\t", *fields).alias("value"))), "enrichment"))
    return got.select("category", "identifier", "name", F.round("pvalue", 6).alias("pvalue"))


@query("select cast(o_orderkey as varchar) as c1, o_orderstatus as c2 from orders")
def sc21_table_without_header(spark, d):
    at = fresh(spark, "table")
    sinks.write_table(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), at, header=False)
    return text.read_table(spark, at, header=False).drop("ord")


@query("select count(*) as n, cast(sum(length(c_name)) as bigint) as chars from customer")
def sc23_lines(spark, d):
    c = table(spark, d, "customer").select(F.concat("c_name", F.lit("\r\n  ")).alias("value"))
    at = _stored(spark, c, "lines")
    return text.lines(spark, at).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).where(F.col("n") == text.count_lines(spark, at))


@query(f"{with_('seqs')} select '>' || name || ':' || doc_id || '-' || (doc_id + length(seq)) || ' (7) a=1 b=2' || chr(10) || rtrim(regexp_replace(seq, '(.{{50}})', '\\1' || chr(10), 'g'), chr(10)) as record from seqs")
def sk02_fasta_record(spark, d):
    s = v.seqs(spark, d).select("name", "seq", F.col("doc_id").alias("start"), (F.col("doc_id") + F.length("seq")).alias("end"), F.lit(7).alias("remaining"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")).alias("meta"))
    return sinks.to_fasta(s, coords=True, meta="meta").select(F.col("value").alias("record"))


@query(f'{with_("rois", "occ")} select chrom || chr(9) || "start" || chr(9) || "end" || chr(9) || name || chr(9) || \'0\' || chr(9) || strand || \' --> \' || \'fam\' || chr(9) || c_start || chr(9) || c_end || chr(9) || c_len as line, \'fam#\' || name as repeat_name from occ')
def sk06_occurrence_text(spark, d):
    o = v.occurrences(spark, d).withColumns({"score": F.lit(0), "family": F.lit("fam")})
    return o.select(sinks.occurrence_text().alias("line"), repeat_name().alias("repeat_name"))
