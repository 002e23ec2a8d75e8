"""One query per operator over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.common import table
from spanloom.functions import sequence as sq
from spanloom.functions import stats
from spanloom.operators import alignment, exons, keyjoin, liftover, overlap, paired, predicates, profile, setops
from spanloom.plans import views as v
from spanloom.plans.views import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


OVER = 'a.chrom = b.chrom and a."start" < b."end" and b."start" < a."end"'

# --- joins


@query(f"{with_('reads', 'rois')} select a.chrom, count(*) as pairs, sum(least(a.\"end\", b.\"end\") - greatest(a.\"start\", b.\"start\")) as bases from reads a join rois b on {OVER} group by 1")
def j01_intersects(spark, d):
    pairs = overlap.overlap_join(v.reads(spark, d), v.regions(spark, d), closed=True).where(predicates.intersects("b_", "a_"))
    return pairs.groupBy(F.col("a_chrom").alias("chrom")).agg(F.count("*").alias("pairs"), F.sum(predicates.overlap_size()).alias("bases"))


@query(f"{with_('reads', 'rois')} select a.name as read, a.\"start\" as read_start, b.name as region from reads a join rois b on {OVER}")
def j02_overlap_join(spark, d):
    pairs = overlap.overlap_join(v.reads(spark, d), v.regions(spark, d))
    return pairs.select(F.col("a_name").alias("read"), F.col("a_start").alias("read_start"), F.col("b_name").alias("region"))


@query(f"{with_('reads', 'rois')} select b.name as region, count(*) as hits from reads a join rois b on a.chrom = b.chrom and a.\"start\" <= b.\"end\" and b.\"start\" <= a.\"end\" group by 1")
def j02_overlap_join_closed(spark, d):
    pairs = overlap.overlap_join(v.reads(spark, d).select("chrom", "start", "end"), v.regions(spark, d).select("chrom", "start", "end", "name"), closed=True)
    return pairs.groupBy(F.col("b_name").alias("region")).agg(F.count("*").alias("hits"))


@query(f"{with_('reads', 'rois')}, j as (select b.name as region, a.\"start\" as s, a.\"end\" as e, a.name as n from rois b left join reads a on {OVER}) select region, coalesce(string_agg(n, ',' order by s, e, n), '') as hits from j group by 1")
def j03_ordered_hits(spark, d):
    got = overlap.bucket_join(v.regions(spark, d).select("chrom", "start", "end", "name"), v.reads(spark, d).select("chrom", "start", "end", "name"))
    return got.select(F.col("name").alias("region"), F.array_join("hits", ",").alias("hits"))


@query(f"{with_('wig', 'points')} select a.chrom, a.pos, b.score from points a join wig b on a.chrom = b.chrom and a.pos >= b.\"start\" and a.pos < b.\"end\"")
def j04_stab_join(spark, d):
    return overlap.stab_join(v.points(spark, d), v.wig(spark, d)).select(F.col("a_chrom").alias("chrom"), F.col("a_pos").alias("pos"), F.col("b_score").alias("score"))


@query(f"{with_('reads', 'rois')} select b.chrom, b.\"start\", b.\"end\", b.name, count(a.name) as n from rois b left join reads a on {OVER} group by all")
def j05_bucket_counts(spark, d):
    return overlap.count_overlaps(v.regions(spark, d).select("chrom", "start", "end", "name"), v.reads(spark, d)).withColumnRenamed("n_overlaps", "n")


def _strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _customers(spark, d):
    return _strings(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


def _orders(spark, d):
    return _strings(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("c_name")))


@query("select cast(s_suppkey as varchar) as k, s_name, p_name, p_brand from supplier join part on s_suppkey = p_partkey")
def j07_unique_keys(spark, d):
    s = _strings(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"))
    return keyjoin.join_tables(s, _strings(table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand")), "k")


@query("select cast(c_custkey as varchar) as c_custkey, c_name, c_mktsegment, cast(o_orderkey as varchar) as o_orderkey, o_orderstatus as c_name_2 from customer join orders on c_custkey = o_custkey")
def j08_all_pairs(spark, d):
    return keyjoin.join_tables(_customers(spark, d), _orders(spark, d), "c_custkey", policy="all_pairwise_combinations")


@query("""with a as (select s_nationkey as k, string_agg(cast(s_nationkey as varchar), ';' order by s_suppkey) as nation, string_agg(s_name, ';' order by s_suppkey) as s_name from supplier group by 1),
b as (select c_nationkey as k, string_agg(c_mktsegment, ';' order by c_custkey) as segments from customer group by 1) select nation, s_name, segments from a join b using (k)""")
def j09_column_wise(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("nation"), "s_name", F.col("s_suppkey").alias("o"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segments"), F.col("c_custkey").alias("o"))
    return keyjoin.join_tables(a, b, "nation", policy="column_wise_join", order="o", right_order="o", header=False)


@query("""with b as (select c_nationkey as k, c_mktsegment as x, min(c_custkey) as o from customer group by all),
c as (select k, string_agg(x, ';' order by o) as segments from b group by 1)
select cast(n_nationkey as varchar) as nation, n_name, segments from nation join c on n_nationkey = k""")
def j09_column_wise_distinct(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("nation"), "n_name", F.col("n_nationkey").alias("o"))
    b = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segments"), F.col("c_custkey").alias("o"))
    return keyjoin.join_tables(a, b, "nation", policy="column_wise_join", order="o", right_order="o")


@query("""select coalesce(cast(c_custkey as varchar), 'NA') as c_custkey, coalesce(c_name, 'NA') as c_name, coalesce(c_mktsegment, 'NA') as c_mktsegment,
coalesce(cast(o_orderkey as varchar), 'NA') as o_orderkey, coalesce(o_orderstatus, 'NA') as c_name_2 from customer full join orders on c_custkey = o_custkey + 7""")
def j10_unpaired(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") + 7).cast("string").alias("c_custkey"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus").alias("c_name"))
    return keyjoin.join_tables(_customers(spark, d), o, "c_custkey", policy="all_pairwise_combinations", missing="NA", unpaired=True)


@query("""with s as (select s_name, case when s_suppkey % 7 = 0 then 'NA' else cast(s_nationkey as varchar) end as k from supplier),
n as (select case when n_nationkey % 5 = 0 then 'NA' else cast(n_nationkey as varchar) end as k, case when n_nationkey % 3 = 0 then 'NA' else n_name end as n_name from nation)
select s_name, s.k, n_name from s join n on s.k = n.k""")
def j11_missing_values(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_name", "if(s_suppkey % 7 = 0, '  ', cast(s_nationkey as string)) as k")
    n = table(spark, d, "nation").selectExpr("if(n_nationkey % 5 = 0, '', cast(n_nationkey as string)) as k", "if(n_nationkey % 3 = 0, ' ', n_name) as n_name")
    return keyjoin.join_tables(s, n, "k", policy="all_pairwise_combinations", missing="NA")


def _streams(spark, d):
    base = table(spark, d, "lineitem").selectExpr("l_returnflag as f", "concat('chr', l_suppkey) as chrom", "l_partkey * 10 as start", "l_partkey * 10 + 10 as end", "cast(l_linenumber as bigint) as score", "if(l_linestatus = 'F', '+', '-') as strand")
    return [base.where(f"f = '{f}'").drop("f") for f in ("A", "N", "R")]


_STREAMS = """with b as (select l_returnflag as f, 'chr' || l_suppkey as chrom, l_partkey * 10 as s, cast(l_linenumber as bigint) as score, case when l_linestatus = 'F' then '+' else '-' end as strand from lineitem),
n as (select *, row_number() over (partition by f, chrom, s{strand} order by score, strand) as o from b)"""


@query(_STREAMS.format(strand="") + """ select a.chrom, a.s as "start", a.score as a, n.score as n, r.score as r from n a join n on a.chrom = n.chrom and a.s = n.s and a.o = n.o join n r on a.chrom = r.chrom and a.s = r.s and a.o = r.o
where a.f = 'A' and n.f = 'N' and r.f = 'R'""")
def j13_paired(spark, d):
    got = paired.paired(_streams(spark, d), ignore_strand=True)
    return got.selectExpr("s0_chrom as chrom", "s0_start as start", "s0_score as a", "s1_score as n", "s2_score as r")


@query(_STREAMS.format(strand=", strand") + """, x as (select chrom, s, strand, o, max(score) filter (f = 'A') as a, max(score) filter (f = 'N') as n, max(score) filter (f = 'R') as r from n group by all)
select chrom, s as "start", strand, coalesce(a, 0) as a, coalesce(n, 0) as n, coalesce(r, 0) as r from x""")
def j13_paired_mirror(spark, d):
    got = paired.paired(_streams(spark, d), mirror=True, mirror_score=0, order=["score"])
    return got.selectExpr("s0_chrom as chrom", "s0_start as start", "s0_strand as strand", "cast(s0_score as bigint) as a", "cast(s1_score as bigint) as n", "cast(s2_score as bigint) as r")


@query("""with b as (select p_brand as chrom, p_partkey * 10 as s, p_retailprice as score from part),
x as (select * from b where s % 30 <> 0), y as (select * from b where s % 50 <> 0)
select coalesce(x.chrom, y.chrom) as chrom, coalesce(x.s, y.s) as "start", coalesce(x.score, -1) as a, coalesce(y.score, -1) as b from x full join y on x.chrom = y.chrom and x.s = y.s""")
def j14_paired_wig(spark, d):
    w = v.wig(spark, d)
    got = paired.paired([w.where("start % 30 <> 0"), w.where("start % 50 <> 0")], mirror=True, mirror_score=-1.0)
    return got.selectExpr("s0_chrom as chrom", "s0_start as start", "s0_score as a", "s1_score as b")


@query("""with a as (select 'read' || l_orderkey || '.1%' || l_linenumber as name, 'read' || l_orderkey as k from lineitem where l_returnflag = 'A'),
b as (select 'read' || l_orderkey || '.2%' || l_linenumber as name, 'read' || l_orderkey as k from lineitem where l_returnflag = 'R'),
x as (select k, string_agg(name, ',' order by name) as l from a group by 1), y as (select k, string_agg(name, ',' order by name) as r from b group by 1)
select coalesce(x.k, y.k) as name, coalesce(l, '') as first, coalesce(r, '') as second from x full join y on x.k = y.k""")
def j15_duplicates(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda f, n: li.where(f"l_returnflag = '{f}'").selectExpr(f"concat('read', l_orderkey, '.{n}%', l_linenumber) as name")
    got = paired.duplicates(side("A", 1), side("R", 2), junction=True, paired_end=True)
    return got.select("name", F.array_join("first", ",").alias("first"), F.array_join("second", ",").alias("second"))


def _sides(spark, d):
    li = table(spark, d, "lineitem")
    return [li.where(f"l_returnflag = '{f}'").selectExpr("cast(l_partkey as string) as name", "cast(l_linenumber as bigint) as score") for f in ("A", "R")]


_SIDES = """with s as (select case l_returnflag when 'A' then 1 else 2 end as side, cast(l_partkey as varchar) as name, cast(l_linenumber as bigint) as score from lineitem where l_returnflag in ('A', 'R')),
n as (select *, row_number() over (partition by side, name order by score) as o from s), x as (select * from n where side = 1), y as (select * from n where side = 2)"""


@query(_SIDES + " select coalesce(x.side, y.side) as side, coalesce(x.name, y.name) as name, coalesce(x.score, y.score) as score from x full join y on x.name = y.name and x.o = y.o where x.side is null or y.side is null")
def j16_unique(spark, d):
    return paired.unique(*_sides(spark, d))


@query(_SIDES + """ select case when y.side is null or x.score < y.score then 1 else 2 end as side, coalesce(x.name, y.name) as name, least(x.score, y.score) as score
from x full join y on x.name = y.name and x.o = y.o where x.side is null or y.side is null or x.score <> y.score""")
def j17_remove_duplicates_best(spark, d):
    a, b = paired.remove_duplicates(*_sides(spark, d), best=True)
    return a.select(F.lit(1).alias("side"), "name", "score").unionByName(b.select(F.lit(2).alias("side"), "name", "score"))


_EXON = "'^(.*)_exon_([0-9]+)_0_(.*)_([0-9]+)_([fr])$'"


@query(f"""with e as (select regexp_extract(name, {_EXON}, 1) as gene, regexp_extract(name, {_EXON}, 3) as chrom, cast(regexp_extract(name, {_EXON}, 4) as bigint) as loc,
case when regexp_extract(name, {_EXON}, 5) = 'r' then '-' else '+' end as strand, "count" as n from exon_counts where regexp_matches(name, {_EXON}))
select gene_id, cast(coalesce(sum(n), 0) as bigint) as total from genes g left join e on e.gene = g.name and e.chrom = g.chrom and e.strand = g.strand and e.loc between g."start" and g."end" group by 1""")
def j18_exons_to_genes(spark, d):
    got = exons.exons_to_genes(table(spark, d, "genes").select("gene_id", "chrom", "start", "end", "name", "strand"), exons.parse_exons(table(spark, d, "exon_counts"), strict=False))
    return got.select("gene_id", F.col("score").alias("total"))


@query(f"""{with_('seqs', 'blocks')}, q as (select cast(o_orderkey * 3000 as bigint) as s, cast(o_orderkey * 3000 + 500 as bigint) as e from orders)
select q.s as "start", block from q join blocks b on b.name = 'A.chr1' and b."start" < q.e and q.s < b."end" """)
def j19_block_lookup(spark, d):
    q = table(spark, d, "orders").selectExpr("'chr1' as chrom", "o_orderkey * 3000 as start", "o_orderkey * 3000 + 500 as end")
    return overlap.overlap_join(q, alignment.genome_blocks(v.blocks(spark, d), "A")).select(F.col("a_start").alias("start"), F.col("b_block").alias("block"))


@query(f"""{with_('seqs', 'blocks', 'cells')}, g as (select c.block, c.name, c.nuc, a.pos from cells c join cells a on a.block = c.block and a.col = c.col and a.name = 'A.chr1' and a.pos is not null),
u as (select pos from g group by pos having count(distinct block) = 1) select g.pos, name, nuc from g join u using (pos)""")
def j20_column_lookup(spark, d):
    return alignment.unique_columns(v.blocks(spark, d), "A").select("pos", "name", "nuc")


@query(f"{with_('wig', 'points')} select a.chrom, a.pos, b.chrom is not null as covered, b.score from points a left join wig b on a.chrom = b.chrom and a.pos >= b.\"start\" and a.pos < b.\"end\"")
def j21_wig_lookup(spark, d):
    return overlap.lookup(v.points(spark, d), v.wig(spark, d))


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey = 42")
def j22_indexed_get(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"{with_('reads', 'rois')} select name, strand from rois b where exists (select 1 from reads a where {OVER} and a.strand = b.strand)")
def j24_overlap_semi(spark, d):
    return overlap.overlap_join(v.regions(spark, d), v.reads(spark, d), how="left_semi", strand=True).select(F.col("a_name").alias("name"), F.col("a_strand").alias("strand"))


@query(f"{with_('reads', 'rois')} select name, \"start\" from reads a where not exists (select 1 from rois b where {OVER})")
def j24_overlap_anti(spark, d):
    return overlap.overlap_join(v.reads(spark, d), v.regions(spark, d), how="left_anti").select(F.col("a_name").alias("name"), F.col("a_start").alias("start"))


# --- set operations


def _islands(src: str, keys: str, where: str = "true") -> str:
    return f"""{src}_p as (select *, max("end") over (partition by {keys} order by "start", "end" rows between unbounded preceding and 1 preceding) as pe from {src} where {where} and "start" < "end"),
{src}_i as (select *, sum(case when pe is null or "start" > pe then 1 else 0 end) over (partition by {keys} order by "start", "end" rows between unbounded preceding and current row) as isl from {src}_p),
{src}_u as (select {keys}, min("start") as "start", max("end") as "end" from {src}_i group by {keys}, isl)"""


_X = "'X' as name, cast(0 as bigint) as score"


@query(f"{with_('reads')}, {_islands('reads', 'chrom')} select chrom, \"start\", \"end\", {_X}, '+' as strand from reads_u")
def i01_collapse(spark, d):
    return setops.collapse(v.reads(spark, d))


@query(f"{with_('visits')}, {_islands('visits', 'chrom, strand', 'strand is not null')} select chrom, \"start\", \"end\", {_X}, strand from visits_u")
def i02_collapse_stranded(spark, d):
    return setops.collapse(v.visits(spark, d), stranded=True)


@query(f"{with_('visits')}, {_islands('visits', 'chrom', 'strand is not null')} select chrom, min(\"start\") as \"start\", max(\"end\") as \"end\", string_agg(distinct name, ';' order by name) as name, cast(0 as bigint) as score, '+' as strand from visits_i group by chrom, isl")
def i03_collapse_names(spark, d):
    return setops.collapse_names(v.visits(spark, d))


@query(f"{with_('rois')} select chrom, \"start\", \"end\", string_agg(distinct name, ';' order by name) as name, arg_min(score, k) as score, arg_min(strand, k) as strand from rois group by chrom, \"start\", \"end\"")
def i04_collapse_exact(spark, d):
    r = v.regions(spark, d).withColumn("k", F.substring("name", 2, 20).cast("long"))
    return setops.collapse_exact(r, "k")


@query(f"{with_('reads', 'rois')}, {_islands('reads', 'chrom')}, {_islands('rois', 'chrom')} select a.chrom, greatest(a.\"start\", b.\"start\") as \"start\", least(a.\"end\", b.\"end\") as \"end\", {_X}, '+' as strand from reads_u a join rois_u b on {OVER}")
def i05_intersection(spark, d):
    return setops.intersection(v.reads(spark, d), v.regions(spark, d))


@query(f"""{with_('reads', 'rois')}, {_islands('reads', 'chrom')}, {_islands('rois', 'chrom')}, s as (select cast(sum(least(a."end", b."end") - greatest(a."start", b."start")) as bigint) as n from reads_u a join rois_u b on {OVER}),
t as (select cast((select sum("end" - "start") from reads_u) + (select sum("end" - "start") from rois_u) - n as bigint) as total from s) select n as shared, total, round(n / total, 9) as jaccard from s, t""")
def i06_jaccard(spark, d):
    return setops.jaccard(v.reads(spark, d), v.regions(spark, d)).select("shared", "total", F.round("jaccard", 9).alias("jaccard"))


@query(f"""{with_('reads', 'rois')}, {_islands('reads', 'chrom')},
h as (select a.name, a."start" as a_s, greatest(a."start", b."start") as hs, least(a."end", b."end") as he from rois a join reads_u b on {OVER}),
pts as (select * from h union all select name, "start", "end", "end" from rois),
g as (select name, greatest(a_s, coalesce(max(he) over (partition by name order by hs, he rows between unbounded preceding and 1 preceding), a_s)) as s, hs as e from pts)
select name, s as "start", e as "end" from g where s < e""")
def i07_subtract(spark, d):
    return setops.subtract(v.regions(spark, d), v.reads(spark, d)).select("name", "start", "end")


@query("select l_suppkey, l_linenumber from lineitem where l_returnflag = 'A' intersect all select l_suppkey, l_linenumber from lineitem where l_returnflag = 'R'")
def i08_intersect_all(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_suppkey", "l_linenumber").intersectAll(li.where("l_returnflag = 'R'").select("l_suppkey", "l_linenumber"))


@query("select l_suppkey, l_linenumber from lineitem where l_returnflag = 'A' except all select l_suppkey, l_linenumber from lineitem where l_returnflag = 'R'")
def i08_except_all(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_suppkey", "l_linenumber").exceptAll(li.where("l_returnflag = 'R'").select("l_suppkey", "l_linenumber"))


@query(f"{with_('visits')}, {_islands('visits', 'chrom')}, g as (select chrom, lag(\"end\") over (partition by chrom order by \"start\") as s, \"start\" as e from visits_u) select chrom, s as \"start\", e as \"end\" from g where s is not null")
def i09_gaps(spark, d):
    return setops.gaps(v.visits(spark, d))


# --- interval scalars

_PAIR = "{with_} select a.name as a, b.name as b".format


@query(f"""{with_('reads', 'rois')}, p as (select a."start" as s1, a."end" as e1, a.strand as st, b.name as bn, a.name as an, b."start" as s2, b."end" as e2, b.strand as bs, a.chrom as c1, b.chrom as c2
from reads a join rois b on split_part(a.name, '_', 1) = cast(b.k as varchar))
select an, bn, e1 - s1 as len, case when c1 = c2 then greatest(0, greatest(s1, s2) - least(e1, e2)) end as distance,
case when c1 = c2 then case when e2 < e1 then -greatest(0, greatest(s1, s2) - least(e1, e2)) else greatest(0, greatest(s1, s2) - least(e1, e2)) end end as signed,
case when c1 = c2 then greatest(0, least(e1, e2) - greatest(s1, s2)) else 0 end as shared, (c1 < c2 or (c1 = c2 and e1 < e2)) as before, st = '+' as positive from p""")
def s01_interval_scalars(spark, d):
    a, b = overlap.prefixed(v.reads(spark, d), "a"), overlap.prefixed(v.regions(spark, d), "b")
    key = F.concat(F.lit("r"), F.substring_index("a_name", "_", 1))
    j = a.join(b, key == F.col("b_name"))
    same = F.col("a_chrom") == F.col("b_chrom")
    return j.select(
        F.col("a_name").alias("an"), F.col("b_name").alias("bn"), predicates.length("a_").alias("len"), F.when(same, predicates.distance()).alias("distance"),
        F.when(same, predicates.signed_distance()).alias("signed"), predicates.overlap_size().alias("shared"), predicates.before().alias("before"), predicates.is_positive(F.col("a_strand")).alias("positive"),
    )


@query(f"""{with_('rois')}, c as (select *, 101 - ("end" - "start") as g from rois)
select name, case when g = 0 then "start" when g > 0 then "start" - (case strand when '+' then g // 2 else (g + 1) // 2 end) else "start" + (case strand when '+' then (-g) // 2 else (1 - g) // 2 end) end as s,
case when g = 0 then "start" when g > 0 then "start" - (case strand when '+' then g // 2 else (g + 1) // 2 end) else "start" + (case strand when '+' then (-g) // 2 else (1 - g) // 2 end) end + 101 as e from c""")
def s09_transform_center(spark, d):
    s, e = predicates.transform_center(101)
    return v.regions(spark, d).select("name", s.alias("s"), e.alias("e"))


@query(f"""select exon_id, regexp_extract(name, {_EXON}, 1) as gene, cast(regexp_extract(name, {_EXON}, 2) as int) as exon_no, regexp_extract(name, {_EXON}, 3) as chrom, cast(regexp_extract(name, {_EXON}, 4) as bigint) as loc
from exon_counts where regexp_matches(name, {_EXON})""")
def s13_parse_exons(spark, d):
    e = table(spark, d, "exon_counts").select("name", F.col("exon_id").alias("count"))
    return exons.parse_exons(e, strict=False).select(F.col("count").alias("exon_id"), "gene", "exon_no", "chrom", "loc")


_JUNCTION = """with b as (select 'chr_' || (l_suppkey % 22 + 1) as chrom, l_partkey * 100 as s1, l_partkey * 100 + 20 + l_suppkey % 30 as e1, l_partkey * 100 + 20 + l_suppkey % 30 + 500 + l_orderkey % 50 as s2,
l_orderkey % 10 + 1 as s, l_orderkey % 10 + 41 + l_linenumber as e, l_orderkey || '_' || l_linenumber as name, cast(l_linenumber as bigint) as score, case when l_linestatus = 'F' then '+' else '-' end as strand from lineitem),
x as (select chrom, s1 + s - 1 as "start", e1 as "end", name || '%1' as name, score, strand, 1 as i, e1 - (s1 + s - 1) as n, s2 + (e - (e1 - s1)) - 1 - s2 as m from b
union all select chrom, s2, s2 + (e - (e1 - s1)) - 1, name || '%2', score, strand, 2, e1 - (s1 + s - 1), s2 + (e - (e1 - s1)) - 1 - s2 from b)
select chrom, "start", "end", name, score, strand from x where """


@query(_JUNCTION + "true")
def s14_junctions_both(spark, d):
    return exons.junctions_to_exons(v.junctions(spark, d))


@query(_JUNCTION + "i = case when n >= m then 1 else 2 end")
def s14_junctions_biggest(spark, d):
    return exons.junctions_to_exons(v.junctions(spark, d), "BIGGEST")


@query(_JUNCTION + "i = case when strand = '+' then 1 else 2 end")
def s14_junctions_five_prime(spark, d):
    return exons.junctions_to_exons(v.junctions(spark, d), "FIVE_PRIME_END")


# --- aggregations


@query(f"{with_('reads', 'rois')} select b.chrom, b.\"start\", b.\"end\", b.name, b.strand, count(a.name) as score from rois b left join reads a on {OVER} group by all")
def a01_read_counts(spark, d):
    return profile.read_counts(v.regions(spark, d), v.reads(spark, d))


@query(f"{with_('seqs')}, c as (select unnest(generate_series(1, length(seq))) as i, seq from seqs) select cast(i - 1 as int) as pos, substr(seq, cast(i as int), 1) as nuc, count(*) as n from c group by all")
def a02_nucleotide_distribution(spark, d):
    return profile.nucleotide_distribution(v.seqs(spark, d))


_PROFILE = f"""{with_('reads', 'rois')}, h as (select {{rel}} as pos from reads a join rois b on a.chrom = b.chrom and a."start" >= b."start" and a."start" < b."end"),
c as (select pos, count(*) as n from h group by 1), g as (select unnest(generate_series(0, (select max(pos) from c))) as pos),
l as (select "end" - "start" as len, count(*) as m from rois group by 1)
select g.pos, round(coalesce(n, 0) / {{div}}, 9) as value from g left join c using (pos)"""


@query(_PROFILE.format(rel='a."start" - b."start"', div="(select sum(m) from l where len > g.pos)"))
def a03_profile_start(spark, d):
    return profile.overlap_profile(v.regions(spark, d), v.reads(spark, d), "START", True).select("pos", F.round("value", 9).alias("value"))


@query(_PROFILE.format(rel="case when b.strand = '+' then a.\"start\" - b.\"start\" else b.\"end\" - a.\"start\" - 1 end", div="1.0"))
def a03_profile_five_prime(spark, d):
    return profile.overlap_profile(v.regions(spark, d), v.reads(spark, d), "5PRIME").select("pos", F.round("value", 9).alias("value"))


_PID = """g as (select c.block, c.col, c.nuc, a.pos from cells c join cells a on a.block = c.block and a.col = c.col and a.name = 'A.chr1' and a.pos is not null),
n as (select block, pos, nuc, count(*) as n from g group by all),
pid as (select pos, max(n) filter (nuc <> '-') / sum(n) as pid from n group by block, pos),
pids as (select pos, min(pid) as pid from pid group by pos having count(*) = 1)"""


@query(f"""{with_('seqs', 'blocks', 'cells')}, {_PID},
r as (select o_orderkey * 997 as s, case when o_orderkey % 2 = 0 then '+' else '-' end as strand from orders),
w as (select s + i as pos, case when strand = '+' then i else 39 - i end as "offset" from r, generate_series(0, 39) t(i))
select cast("offset" as int) as "offset", round(avg(pid), 9) as pid from w left join pids using (pos) group by all""")
def a04_conservation_profile(spark, d):
    r = table(spark, d, "orders").selectExpr("'chr1' as chrom", "o_orderkey * 997 as start", "o_orderkey * 997 + 40 as end", "if(o_orderkey % 2 = 0, '+', '-') as strand")
    return alignment.conservation_profile(r, v.blocks(spark, d), "A", 40).select("offset", F.round("pid", 9).alias("pid"))


@query(f"{with_('seqs', 'blocks', 'cells')}, {_PID} select 'chr1' as chrom, pos, round(pid, 9) as pid from pids")
def a06_pid(spark, d):
    return alignment.pids(v.blocks(spark, d), "A").select("chrom", "pos", F.round("pid", 9).alias("pid"))


@query("select event_id, round(avg(value) over (partition by user_id order by event_id rows unbounded preceding), 9) as mean from events")
def a07_running_mean(spark, d):
    return stats.running_mean(table(spark, d, "events"), "value", "event_id", ["user_id"], width=4096).select("event_id", F.round("mean", 9).alias("mean"))


@query(f"{with_('seqs')} select doc_id, round((length(seq) - length(replace(seq, 'A', ''))) / length(seq), 9) as a, (length(seq) - length(replace(seq, 'N', ''))) / length(seq) >= 0.1 as low from seqs")
def a08_percent_nuc(spark, d):
    return v.seqs(spark, d).select("doc_id", F.round(sq.percent_nuc("seq", "A"), 9).alias("a"), sq.is_low_quality("seq").alias("low"))


@query("with a as (select l_partkey as term, l_tax as p from lineitem where l_returnflag = 'A' union all select l_partkey, l_discount from lineitem where l_returnflag = 'R') select term, min(p) as p from a group by 1 having min(p) < 0.02")
def a09_min_over_files(spark, d):
    li = table(spark, d, "lineitem")
    return keyjoin.min_over_files([li.where("l_returnflag = 'A'").selectExpr("l_partkey as term", "l_tax as p"), li.where("l_returnflag = 'R'").selectExpr("l_partkey as term", "l_discount as p")], "term", "p", 0.02)


@query(f"{with_('rois', 'occ')}, p as (select name, unnest(generate_series(c_start, c_end - 1)) as pos from occ where c_start < c_end) select name, pos, count(*) as depth from p group by all")
def a10_consensus_coverage(spark, d):
    o = v.occurrences(spark, d).select("name", F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    return profile.consensus_coverage(o)


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as q from lineitem group by cube (l_returnflag, l_linestatus)")
def a11_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


# --- sequences


@query(f"""{with_('seqs')} select doc_id, length(replace(replace(seq, 'N', '-'), '-', '')) as ungapped, length(replace(seq, 'N', '')) as effective, length(seq) as gapped, substr(seq, 1, 1) as first,
'NNNNN' || substr(seq, 6) as l5, substr(seq, 1, length(seq) - 5) || 'NNNNN' as r5, substr(seq, 1, 1) || 'NNN' || substr(seq, 5) as masked, substr(seq, 1, 30) as cut,
substr(seq, 1, length(seq) // 2) as half1, substr(seq, length(seq) // 2 + 1) as half2, replace(seq, 'T', 'U') as rna, regexp_full_match(seq, '[ACGTN]*') as dna, regexp_full_match(seq, '[ACGUN]*') as is_rna from seqs where length(seq) >= 20""")
def q01_sequence_scalars(spark, d):
    s = v.seqs(spark, d).where("length(seq) >= 20")
    halves = sq.split_at("seq", "name")
    return s.select(
        "doc_id", sq.ungapped_len(F.replace("seq", F.lit("N"), F.lit("-"))).alias("ungapped"), sq.effective_len("seq").alias("effective"), sq.gapped_len("seq").alias("gapped"), sq.nucleotide("seq", 0).alias("first"),
        sq.ns_left("seq", 5).alias("l5"), sq.ns_right("seq", 5).alias("r5"), sq.mask_region("seq", 1, 3).alias("masked"), sq.truncate("seq", 30).alias("cut"),
        halves[0]["seq"].alias("half1"), halves[1]["seq"].alias("half2"), sq.to_rna("seq").alias("rna"), sq.is_dna("seq").alias("dna"), sq.is_rna("seq").alias("is_rna"),
    )


@query(f"{with_('seqs')} select doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from seqs")
def q08_reverse_complement(spark, d):
    return v.seqs(spark, d).select("doc_id", sq.reverse_complement("seq").alias("rc"))


@query(f"""{with_('seqs')}, z as (select doc_id, replace(seq, 'N', '-') as s, length(seq) as n, unnest(generate_series(0, 2)) as k from seqs),
t as (select *, n * k // 3 + 1 as f, n * (k + 1) // 3 + 1 as e from z)
select doc_id, k, substr(s, cast(f as int), cast(e - f as int)) as piece, cast(1000 + length(replace(substr(s, 1, cast(f - 1 as int)), '-', '')) as bigint) as "start", cast(length(replace(substr(s, cast(e as int)), '-', '')) + 7 as bigint) as remaining from t""")
def q06_gapped_subsequence(spark, d):
    # thirds, so that every symbol is in one piece
    s = v.seqs(spark, d).select("doc_id", F.replace("seq", F.lit("N"), F.lit("-")).alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("k"))
    first, stop = F.expr("cast(length(s) * k div 3 + 1 as int)"), F.expr("cast(length(s) * (k + 1) div 3 + 1 as int)")
    x = sq.gapped_subsequence("s", F.lit(1000).cast("long"), F.lit("+"), F.lit(7).cast("long"), first, stop)
    return s.select("doc_id", "k", x.alias("x")).select("doc_id", "k", F.col("x.seq").alias("piece"), F.col("x.start").alias("start"), F.col("x.remaining").alias("remaining"))


@query(f"""{with_('seqs')}, c as (select doc_id, seq, unnest(generate_series(1, length(seq) - 5)) as i from seqs),
m as (select doc_id, count(*) filter (substr(seq, cast(i as int), 1) = substr(seq, cast(i + 5 as int), 1)) as same from c group by 1) select doc_id, coalesce(same, 0) as same from seqs left join m using (doc_id)""")
def q07_similarity(spark, d):
    n = F.length("seq")
    return v.seqs(spark, d).select("doc_id", F.when(n > 5, sq.similarity("seq", 0, n - 6, "seq", 5, n - 1)).otherwise(0).cast("long").alias("same"))


_HITS = " + ".join(f"case when i + {k} >= 1 and substr(seq, cast(i + {k} as int), 1) = '{c}' then 1 else 0 end" for k, c in enumerate("AGATCGGAAG", 1))


@query(f"""{with_('seqs')}, w as (select doc_id, seq, unnest(generate_series(-9, greatest(length(seq) - 10, -1))) as i from seqs), b as (select doc_id, max(i) filter ({_HITS} >= 8) as hit from w group by 1)
select doc_id, case when hit is null then seq else substr(seq, 1, cast(greatest(hit, 0) as int)) || repeat('N', cast(length(seq) - greatest(hit, 0) as int)) end as clipped from seqs join b using (doc_id)""")
def q15_clip_adaptor(spark, d):
    return v.seqs(spark, d).select("doc_id", sq.clip_adaptor("seq", F.lit("AGATCGGAAGAGC")).alias("clipped"))


@query(f"{with_('seqs')} select doc_id, regexp_matches(seq, '^A.C') as m, regexp_matches(seq, '^A.T.*') and length(seq) >= 9 as l from seqs")
def q17_mask_match(spark, d):
    return v.seqs(spark, d).select("doc_id", sq.mask_match("seq", F.lit("AnC")).alias("m"), sq.mask_match("seq", F.lit("ANTNNNNNN")).alias("l"))


@query(f"{with_('seqs')} select doc_id, ascii(substr(translate(seq, 'ACGTN', 'IHGF#'), 3, 1)) - 33 as q, substr(seq, 4) as left_cut, substr(seq, 1, length(seq) - 3) as right_cut, reverse(translate(seq, 'ACGTN', 'IHGF#')) as back from seqs where length(seq) > 6")
def q20_reads(spark, d):
    r = v.fastq(spark, d).where("length(seq) > 6")
    return r.select("doc_id", sq.relative_quality("qual", 2).alias("q"), sq.trim_left("seq", 3).alias("left_cut"), sq.trim_right("seq", 3).alias("right_cut"), F.reverse("qual").alias("back"))


# --- alignments


@query(f"{with_('seqs', 'blocks', 'cells')} select block, col, name, nuc from cells")
def l01_columns(spark, d):
    b = v.blocks(spark, d)
    every = b.groupBy("block").agg(F.max(F.length("seq")).alias("w")).select("block", F.explode(F.sequence(F.lit(1), F.col("w"))).alias("col"))
    return alignment.columns_at(b, every).select("block", F.col("col").cast("long").alias("col"), "name", "nuc")


@query(f"""{with_('seqs', 'blocks', 'cells')}, z as (select block, name, length(seq) as w, unnest(generate_series(0, 7)) as k from blocks), q as (select block, name, w * k // 8 + 1 as f, w * (k + 1) // 8 + 1 as t from z)
select q.block, q.name, f as "first", min(pos) as seq_start, max(pos) + 1 as seq_end from q left join cells c on c.block = q.block and c.name = q.name and col >= f and col < t where f < t group by all""")
def l02_column_to_sequence(spark, d):
    b = v.blocks(spark, d)
    # eighths tile each block
    q = b.select("block", "name", F.length("seq").cast("long").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).selectExpr("block", "name", "w * k div 8 + 1 as first", "w * (k + 1) div 8 + 1 as stop").where("first < stop")
    return alignment.column_to_sequence(b, q).select("block", "name", "first", "seq_start", "seq_end")


_RUNS = "c as (select block, name, col, pos, col - row_number() over (partition by block, name order by col) as isl from cells where pos is not null)"


@query(f"{with_('seqs', 'blocks', 'cells')}, {_RUNS} select block, name, min(col) as col_start, max(col) + 1 as col_end from c group by block, name, isl")
def l03_sequence_to_columns(spark, d):
    b = v.blocks(spark, d)
    got = alignment.sequence_to_columns(b, b.select("block", "name", F.col("start").alias("first"), F.col("end").alias("stop")), trim=True)
    return got.select("block", "name", F.col("col_start").cast("long").alias("col_start"), F.col("col_end").cast("long").alias("col_end"))


@query(f"{with_('seqs', 'blocks', 'cells')}, {_RUNS}, l as (select c.block, c.isl, min(o.pos) as dest_start, max(o.pos) + 1 as dest_end from c join cells o on o.block = c.block and o.col = c.col and o.name = 'B.chr1' and o.pos is not null where c.name = 'A.chr1' group by all) select block, dest_start, dest_end from l")
def l04_liftover(spark, d):
    b = v.blocks(spark, d)
    q = b.where("name = 'A.chr1'").select("block", F.lit("A.chr1").alias("origin"), F.lit("B.chr1").alias("dest"), F.col("start").alias("first"), F.col("end").alias("stop"))
    return alignment.liftover(b, q).select("block", "dest_start", "dest_end")


@query(f"""{with_('rois', 'occ')}, q as (select *, "start" as gs, "end" as ge, "start" - 5 + c_len % 40 as qs, "start" - 5 + c_len % 40 + 25 as qe from occ),
z as (select *, ge - gs as n, (c_end - c_start) - (ge - gs) as d, greatest(qs - gs, 0) as a, greatest(qe - gs, 0) as b from q where qs < ge and gs < qe),
g as (select *, greatest(n // greatest(-d, 1), 1) as gi, greatest(cast(ceil(n / greatest(d, 1)) as bigint), 1) as gd, least(b, n) as t from z),
e as (select chrom, gs, name, strand, qs, case when strand = '-' then c_end - least(b, n) else a + c_start end as s, case when strand = '-' then c_end - a else least(b + c_start, c_len) end as e from g where d = 0
union all select chrom, gs, name, strand, qs, case when strand = '-' then greatest(c_end - b + b // gi, c_start) else a + c_start - a // gi end, case when strand = '-' then least(c_end - a + a // gi, c_end) else least(b + c_start - b // gi, c_len) end from g where d < 0
union all select chrom, gs, name, strand, qs, case when strand = '-' then greatest(c_end - y - k, c_start) else c_start + x + k end, case when strand = '-' then c_end - x - k else least(c_start + y + k, c_end) end
from (select *, greatest(a, k * gd) as x, least(t, (k + 1) * gd) as y from (select *, unnest(generate_series(a // gd, (t - 1) // gd)) as k from g where d > 0 and t > a)))
select chrom, gs as g_start, name, strand, qs as q_start, s as lift_start, e as lift_end from e where s < e""")
def l06_liftover_coordinates(spark, d):
    o = v.occurrences(spark, d).selectExpr("chrom", "start as g_start", "end as g_end", "strand", "name", "c_start", "c_end", "c_len", "start - 5 + c_len % 40 as q_start", "start - 5 + c_len % 40 + 25 as q_end")
    return liftover.liftover_coordinates(o).select("chrom", "g_start", "name", "strand", "q_start", "lift_start", "lift_end")


# --- statistics


@query("""with p as (select o_orderkey, ((o_orderkey * 7919) % 100003 + 1) / 100004.0 as p from orders), r as (select *, row_number() over (order by p, o_orderkey) as rn, count(*) over () as n from p)
select o_orderkey, round(least(1.0, min(p * n / rn) over (order by rn desc rows unbounded preceding)), 9) as q from r""")
def m01_bh(spark, d):
    return stats.correct_pvalues(v.pvals(spark, d), "p").select("o_orderkey", F.round("q", 9).alias("q"))


_FISHER = """with t as (select l_suppkey, count(*) filter (l_returnflag = 'A' and l_linestatus = 'F') as a, count(*) filter (l_returnflag = 'A' and l_linestatus = 'O') as b,
  count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') as c, count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as d from lineitem group by 1),
s as (select *, a + c as m, b + d as n, a + b as k from t),
x as (select *, unnest(generate_series(greatest(0, k - n), least(k, m))) as i from s),
w as (select l_suppkey, a, i, exp(lgamma(m + 1.0) - lgamma(i + 1.0) - lgamma(m - i + 1.0) + lgamma(n + 1.0) - lgamma(k - i + 1.0) - lgamma(n - k + i + 1.0) - lgamma(m + n + 1.0) + lgamma(k + 1.0) + lgamma(m + n - k + 1.0)) as p from x),
o as (select l_suppkey, p as here from w where i = a)
select l_suppkey, round(sum(case when p <= here * (1 + 1e-7) then p else 0 end), 7) as p from w join o using (l_suppkey) group by 1"""


@query(_FISHER)
def m03_fisher(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.sum(F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), 1).otherwise(0)).alias(f"{f}{s}") for f in "AR" for s in "FO"])
    return t.select("l_suppkey", stats.fisher_exact("AF", "AO", "RF", "RO").alias("x")).select("l_suppkey", F.round("x.p", 7).alias("p"))


_BETAS = """with v as (select p_partkey, p_size + 0.5 as a, p_partkey % 20 + 1.0 as b, (p_partkey % 99 + 0.5) / 100 as x from part),
j as (select p_partkey, a, b, x, unnest(generate_series(0, cast(b as bigint) - 1)) as j from v),
i as (select p_partkey, sum(exp(a * ln(x) + lgamma(a + j) - lgamma(a) - lgamma(j + 1.0) + j * ln(1 - x))) as inc from j group by 1)"""


@query(_BETAS + " select p_partkey, round(exp(lgamma(a) + lgamma(b) - lgamma(a + b)), 9) as beta, round(inc, 9) as inc, round(exp((a - 1) * ln(x) + (b - 1) * ln(1 - x) - lgamma(a) - lgamma(b) + lgamma(a + b)), 9) as pdf, round(inc, 9) as cdf from v join i using (p_partkey)")
def m04_beta(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_size + 0.5D as a", "p_partkey % 20 + 1.0D as b", "(p_partkey % 99 + 0.5D) / 100 as x")
    return p.select("p_partkey", *[F.round(c, 9).alias(n) for n, c in (("beta", stats.beta("a", "b")), ("inc", stats.reg_incomplete_beta("a", "b", "x")), ("pdf", stats.beta_pdf("x", "a", "b")), ("cdf", stats.beta_cdf("x", "a", "b")))])


@query("with p as (select ((o_orderkey * 7919) % 100003 + 1) / 100004.0 as p, o_orderkey from orders), r as (select *, row_number() over (order by p, o_orderkey) as rn, count(*) over () as n, (select sum(1.0 / i) from generate_series(1, (select count(*) from orders)) t(i)) as h from p) select o_orderkey, round(least(1.0, min(p * n * h / rn) over (order by rn desc rows unbounded preceding)), 7) as q from r")
def m01_by(spark, d):
    return stats.correct_pvalues(v.pvals(spark, d), "p", method="BY").select("o_orderkey", F.round("q", 7).alias("q"))


@query("select cast(10000 as bigint) as draws, cast(0 as bigint) as strangers, true as near")
def m07_weighted_choice(spark, d):
    """What must hold of any draw: its size, that only candidates are drawn, and that each share is near its weight's."""
    c = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    n = stats.weighted_choice(c, "p_partkey", "w", 10_000, seed=7).groupBy("p_partkey").agg(F.count("*").alias("n"))
    both = n.join(c, "p_partkey", "full").select(F.coalesce("n", F.lit(0)).alias("n"), "w")
    one = both.agg(F.sum("n").alias("draws"), F.count(F.when(F.col("w").isNull() | ((F.col("w") <= 0) & (F.col("n") > 0)), 1)).alias("strangers"), F.corr("n", "w").alias("r"), F.sum(F.col("n") * F.col("w")).alias("nw"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"))
    # the mean weight of what is drawn is the weights' own mean weight, give or take
    return one.select("draws", "strangers", (F.abs(F.col("nw") / F.col("draws") / (F.col("sww") / F.col("sw")) - 1) < 0.03).alias("near"))


@query("select cast(1001 as bigint) as n, true as one, true as positive")
def m08_random_probabilities(spark, d):
    p = stats.random_probabilities(spark, 1000, seed=3)
    return p.agg(F.count("*").alias("n"), (F.abs(F.sum("p") - 1) < 1e-9).alias("one"), (F.min("p") >= 0).alias("positive"))


# --- what else there is of sequences, reads, intervals and alignments


@query(f"""{with_('seqs')}, z as (select doc_id, replace(seq, 'N', '-') as s, length(replace(seq, 'N', '')) as n from seqs),
c as (select doc_id, s, n, unnest(generate_series(1, length(s))) as i from z), r as (select *, sum(case when substr(s, cast(i as int), 1) <> '-' then 1 else 0 end) over (partition by doc_id order by i rows unbounded preceding) as rk, substr(s, cast(i as int), 1) <> '-' as base from c),
m as (select doc_id, min(i) filter (base and rk > n // 3) as a, max(i) filter (base and rk <= 2 * n // 3) as b from r group by 1)
select doc_id, case when a is null or b is null or a > b then '' else substr(s, cast(a as int), cast(b - a + 1 as int)) end as piece from z join m using (doc_id)""")
def q04_subsequence(spark, d):
    s = v.seqs(spark, d).select("doc_id", F.replace("seq", F.lit("N"), F.lit("-")).alias("s"), F.length(F.replace("seq", F.lit("N"), F.lit(""))).cast("long").alias("n"))
    start = F.lit(1000).cast("long")
    return s.select("doc_id", sq.subsequence("s", start, start + F.expr("n div 3"), start + F.expr("2 * n div 3")).alias("piece"))


@query(f"{with_('seqs')} select doc_id, true as itself, doc_id % 2 <> 0 as other from seqs")
def q18_equality(spark, d):
    s = v.seqs(spark, d).select("doc_id", *[x for t in "ab" for x in (F.col("seq").alias(f"{t}_seq"), F.col("name").alias(f"{t}_name"), F.lit(1).alias(f"{t}_start"), F.length("seq").alias(f"{t}_end"), F.lit(None).cast("long").alias(f"{t}_remaining"))])
    meta = lambda k: F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), k)
    s = s.withColumns({"a_meta": meta(F.lit("2")), "b_meta": F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1"))})
    other = s.withColumn("b_meta", meta(F.when(F.col("doc_id") % 2 == 0, "3").otherwise("2")))
    return s.select("doc_id", sq.equal_sequences("a_", "b_").alias("itself")).join(other.select("doc_id", sq.equal_sequences("a_", "b_").alias("other")), "doc_id")


@query(f"{with_('seqs')} select doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) as seq, reverse(translate(seq, 'ACGTN', 'IHGF#')) as qual from seqs")
def q21_read_reverse_complement(spark, d):
    return v.fastq(spark, d).select("doc_id", sq.reverse_complement_read(rna=False).alias("x")).select("doc_id", "x.seq", "x.qual")


@query(f"""{with_('seqs')}, h as (select *, length(seq) // 2 as k, translate(seq, 'ACGTN', 'IHGF#') as qual from seqs)
select name || '.1' as name, substr(seq, 1, k) as seq, substr(qual, 1, k) as qual from h union all select name || '.2', substr(seq, k + 1), substr(qual, k + 1) from h""")
def q22_read_split(spark, d):
    return v.fastq(spark, d).select(F.explode(sq.split_read()).alias("x")).select("x.*")


@query(f"{with_('seqs')} select name, seq || reverse(seq) as seq, translate(seq, 'ACGTN', 'IHGF#') || reverse(translate(seq, 'ACGTN', 'IHGF#')) as qual from seqs")
def q23_merge_reads(spark, d):
    r = v.fastq(spark, d).select(F.col("name").alias("a_name"), F.col("seq").alias("a_seq"), F.col("qual").alias("a_qual"), F.concat("name", F.lit("x")).alias("b_name"), F.reverse("seq").alias("b_seq"), F.reverse("qual").alias("b_qual"))
    name, seq, qual = sq.merge_reads("a", "b", force=True)
    return r.select(name.alias("name"), seq.alias("seq"), qual.alias("qual"))


@query(f"{with_('seqs')}, w as (select doc_id, seq, unnest(generate_series(-9, greatest(length(seq) - 10, -1))) as i from seqs) select doc_id, coalesce(bool_or({_HITS} >= 8 and substr(seq, cast(greatest(i, 0) + 1 as int)) <> repeat('N', cast(length(seq) - greatest(i, 0) as int))), false) as has from w group by 1")
def q24_contains_adaptor(spark, d):
    return v.seqs(spark, d).select("doc_id", sq.contains_adaptor("seq", F.lit("AGATCGGAAGAGC")).alias("has"))


@query("select doc_id, 'kernel=' || kernel || ' lang=' || lang as meta, case when doc_id % 2 = 0 then 'a=1 b=3 c=4' else 'a=1 b=2 c=4' end as merged from documents where kernel is not null and lang is not null")
def q25_meta(spark, d):
    t = table(spark, d, "documents").where("kernel is not null and lang is not null")
    first, second = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.create_map(F.when(F.col("doc_id") % 2 == 0, "b").otherwise("c"), F.when(F.col("doc_id") % 2 == 0, "3").otherwise("4"), F.when(F.col("doc_id") % 2 == 0, "c").otherwise("d"), F.lit("4"))
    second = F.map_filter(second, lambda k, _: k != "d")
    return t.select("doc_id", sq.meta_to_string(F.create_map(F.lit("lang"), F.col("lang"), F.lit("kernel"), F.col("kernel"))).alias("meta"), sq.meta_to_string(sq.merge_maps(first, second)).alias("merged"))


@query(f"{with_('seqs')} select doc_id, cast(case when doc_id % 2 = 0 then 77 else length(seq) end as bigint) as n from seqs")
def q26_unknown_sequence(spark, d):
    s = v.seqs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 != 0, F.col("seq")).alias("s"), F.length("seq").alias("n"))
    return s.select("doc_id", sq.unknown_len("s", F.lit(5).cast("long"), F.when(F.col("s").isNull(), F.lit(82).cast("long")).otherwise(F.col("n") + 5)).alias("n"))


@query(f"{with_('visits')}, p as (select a.event_id, a.chrom is not distinct from b.chrom and a.\"start\" = b.\"start\" and a.\"end\" = b.\"end\" and a.name = b.name and a.strand is not distinct from b.strand as same, a.score = b.score as s from visits a join (select event_id, chrom, \"start\", \"end\", name, score + case when event_id % 3 = 0 then 1 else 0 end as score, case when event_id % 5 = 1 then '-' else strand end as strand from visits) b using (event_id)) select event_id, same, same and s as equal from p")
def s02_equality(spark, d):
    a = v.visits(spark, d)
    b = a.withColumns({"score": F.col("score") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0), "strand": F.when(F.col("event_id") % 5 == 1, "-").otherwise(F.col("strand"))})
    j = overlap.prefixed(a, "a").join(overlap.prefixed(b, "b"), F.col("a_event_id") == F.col("b_event_id"))
    return j.select(F.col("a_event_id").alias("event_id"), predicates.same_region().alias("same"), predicates.equal().alias("equal"))


@query(f"{with_('rois')} select name, \"start\" + 15 - 31 as s_start, \"start\" + 15 as s_end, \"end\" - 15 as e_start, \"end\" - 15 + 31 as e_end, \"start\" + (\"end\" - \"start\") // 2 - 15 as m_start, \"start\" + (\"end\" - \"start\") // 2 - 15 + 31 as m_end from rois")
def s10_anchor_windows(spark, d):
    cols = [c.alias(f"{k[0]}_{n}") for k in ("start", "end", "middle") for c, n in zip(predicates.anchor_window(k, 31), ("start", "end"))]
    return v.regions(spark, d).select("name", *cols)


@query(f"{with_('visits')}, o as (select *, lead(\"start\") over (partition by chrom order by \"start\", event_id) as n, lead(event_id) over (partition by chrom order by \"start\", event_id) as e from visits) select event_id, e as next_event, n - \"end\" as hole from o")
def s11_next_interval(spark, d):
    got = paired.with_next(v.visits(spark, d).select("chrom", "start", "end", "event_id"), ["chrom"], ["start", "event_id"])
    return got.select("event_id", F.col("next_event_id").alias("next_event"), (F.col("next_start") - F.col("end")).alias("hole"))


@query(f"{with_('rois')} select name, \"start\" from rois")
def s12_assert_sorted(spark, d):
    return overlap.assert_sorted(v.regions(spark, d), "start", lambda: F.struct("start", "name")).select("name", "start")


@query(f"""{with_('seqs', 'blocks', 'cells')}, {_PID},
r as (select 'r' || o_orderkey as name, o_orderkey * 997 as s, case when o_orderkey % 2 = 0 then '+' else '-' end as strand from orders),
w as (select name, s + i as pos, case when strand = '+' then i else 39 - i end as "offset" from r, generate_series(0, 39) t(i))
select name, "offset", round(pid, 9) as pid from w left join pids using (pos)""")
def a05_region_profiles(spark, d):
    r = table(spark, d, "orders").selectExpr("concat('r', o_orderkey) as name", "'chr1' as chrom", "o_orderkey * 997 as start", "o_orderkey * 997 + 40 as end", "if(o_orderkey % 2 = 0, '+', '-') as strand")
    return alignment.region_profiles(r, v.blocks(spark, d), "A").select("name", "offset", F.round("pid", 9).alias("pid"))


@query(f"""{with_('rois', 'occ', 'reads')}, q as (select distinct o.*, o."start" as gs, o."end" as ge, r."start" as qs, r."end" as qe from occ o join (select distinct chrom, "start", "end" from reads) r on o.chrom = r.chrom and r."start" < o."end" and o."start" < r."end"),
z as (select *, ge - gs as n, (c_end - c_start) - (ge - gs) as d, greatest(qs - gs, 0) as a, greatest(qe - gs, 0) as b from q),
g as (select *, greatest(n // greatest(-d, 1), 1) as gi, greatest(cast(ceil(n / greatest(d, 1)) as bigint), 1) as gd, least(b, n) as t from z),
e as (select name, case when strand = '-' then c_end - least(b, n) else a + c_start end as s, case when strand = '-' then c_end - a else least(b + c_start, c_len) end as e from g where d = 0
union all select name, case when strand = '-' then greatest(c_end - b + b // gi, c_start) else a + c_start - a // gi end, case when strand = '-' then least(c_end - a + a // gi, c_end) else least(b + c_start - b // gi, c_len) end from g where d < 0
union all select name, case when strand = '-' then greatest(c_end - y - k, c_start) else c_start + x + k end, case when strand = '-' then c_end - x - k else least(c_start + y + k, c_end) end
from (select *, greatest(a, k * gd) as x, least(t, (k + 1) * gd) as y from (select *, unnest(generate_series(a // gd, (t - 1) // gd)) as k from g where d > 0 and t > a))),
p as (select name, unnest(generate_series(s, e - 1)) as pos from e where s < e) select name, pos, count(*) as depth from p group by all""")
def a10_lifted_coverage(spark, d):
    """Reads laid on the repeats' occurrences, lifted to the consensus and counted there."""
    r = v.reads(spark, d).select("chrom", "start", "end").distinct()
    lifted = liftover.liftover_occurrences(r, v.occurrences(spark, d).distinct())
    return profile.consensus_coverage(lifted.select("name", F.col("lift_start").alias("start"), F.col("lift_end").alias("end")))


def _repeat_rows(spark, d):
    """The blocks as alignments of a genome and a repeat, in the columns of ``read_repeat_alignments``."""
    b = v.blocks(spark, d)
    side = lambda n, p: b.where(f"name = '{n}'").select(F.col("block"), *[F.col(c).alias(f"{p}_{c}") for c in ("seq", "start", "end", "strand")])
    return side("A.chr1", "q").join(side("B.chr1", "r"), "block").withColumn("uniq_id", F.col("block").cast("string"))


@query(f"""{with_('seqs', 'blocks', 'cells')}, {_RUNS}, w as (select c.block, c.isl, min(o.pos) as s, max(o.pos) + 1 as e from c join cells o on o.block = c.block and o.col = c.col and o.name = 'B.chr1' and o.pos is not null where c.name = 'A.chr1' group by all),
g as (select block, "start" as gs, "end" as ge from blocks where name = 'A.chr1' and "start" < "end")
select name, lift_start, lift_end from (
select 'f' || w.block % 7 as name, s as lift_start, e as lift_end from w join g using (block) where w.block % 2 = 0
union all select 'f' || block % 7, 0, ge - gs from g where block % 2 <> 0)""")
def l05_occurrence_liftover(spark, d):
    """Even blocks are lifted through their alignment, odd ones by their coordinates."""
    rows = _repeat_rows(spark, d).where("q_start < q_end")
    occ = rows.selectExpr("concat('chr', block) as chrom", "q_start as start", "q_end as end", "'+' as strand", "concat('f', block % 7) as name", "0L as c_start", "q_end - q_start as c_end", "q_end - q_start as c_len", "uniq_id")
    got = liftover.liftover_occurrences(occ.select("chrom", "start", "end"), occ, rows.where("block % 2 = 0"))
    return got.select("name", "lift_start", "lift_end")


@query(f"""{with_('seqs', 'blocks')}, b as (select block, max(length(seq)) as n from blocks group by 1)
select block, case when block % 3 = 0 and n > 0 then 'sequences of unequal length' when block % 3 = 1 then 'a name occurs twice' when block % 3 = 2 then 'coordinates don''t fit' end as reason from b where block % 3 <> 0 or n > 0""")
def l10_block_checks(spark, d):
    b = v.blocks(spark, d)
    second = F.col("name") == "B.chr1"
    bad = b.withColumns({
        "seq": F.when(second & (F.col("block") % 3 == 0), F.expr("substring(seq, 2)")).otherwise(F.col("seq")),
        "name": F.when(second & (F.col("block") % 3 == 1), "A.chr1").otherwise(F.col("name")),
        "end": F.when(second & (F.col("block") % 3 == 2), F.col("end") + 1).otherwise(F.col("end")),
    })
    return alignment.check_blocks(bad)


@query(f"{with_('seqs', 'blocks')} select block, 'chr1' || chr(9) || \"start\" || chr(9) || \"end\" as key, 'chr1' as chrom, \"start\", \"end\" from blocks where name = 'A.chr1'")
def l11_block_key(spark, d):
    g = alignment.genome_blocks(v.blocks(spark, d), "A")
    keyed = g.select("block", alignment.block_key(F.col("chrom"), F.col("start"), F.col("end")).alias("key"))
    return keyed.select("block", "key", alignment.parse_block_key(F.col("key")).alias("x")).select("block", "key", "x.*")


@query(f"{with_('seqs', 'blocks')} select block, max(length(seq)) as size, count(*) as num_seqs from blocks group by 1")
def l12_block_sizes(spark, d):
    return alignment.block_sizes(v.blocks(spark, d))
