"""Line formats: BED, four-column WIG, delimited tables, exon counts, repeat annotations, enrichment tables.

All of them are ``spark.read.text`` and column expressions, so files are split, pruned and parsed inside the JVM. ANSI
casts make a malformed number fail at run time; ``strict=False`` leaves such lines out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.common import strip

PATH = "_metadata.file_path"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The non-blank lines (``value``), without a carriage return at the end."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value")).where("value rlike '\\\\S'")


def count_lines(spark: SparkSession, path: str | list[str]) -> int:
    return lines(spark, path).count()


def _field(i: int) -> Column:
    return F.try_element_at(F.col("f"), F.lit(i))


def _fail(why: str, c: Column, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{why}: "), c)).cast(kind)


def _number(i: int, kind: str, why: str, strict: bool) -> Column:
    got = F.trim(_field(i)).try_cast(kind)
    return F.when(got.isNotNull(), got).when(_field(i).isNotNull(), _fail(why, F.col("value"), kind)) if strict else got


def parse_bed(df: DataFrame, score: str = "long", drop_after: int | None = None, strict: bool = True) -> DataFrame:
    """``value`` lines as chrom, start, end, name, score, strand. Absent fields are null, fields beyond six ignored.

    ``drop_after`` ignores fields from that number on. Fewer than three fields, a start, end or score that is no number
    and a strand other than + and - fail, or are left out without ``strict``.
    """
    f = F.split("value", "\t")
    df = df.withColumn("f", F.slice(f, 1, drop_after) if drop_after else f)
    strand = strip(_field(6))
    good = (F.size("f") >= 3) & _number(2, "long", "", False).isNotNull() & _number(3, "long", "", False).isNotNull()
    good &= strand.isNull() | strand.isin("+", "-", "")
    good &= _field(5).isNull() | F.trim(_field(5)).try_cast(score).isNotNull()
    if not strict:
        df = df.where(good)
    else:
        df = df.where(F.when(F.size("f") >= 3, True).otherwise(_fail("fewer than three fields", F.col("value"), "boolean")))
        df = df.where(F.when(strand.isNull() | strand.isin("+", "-", ""), True).otherwise(_fail("unknown strand", F.col("value"), "boolean")))
    cols = [strip(_field(1)).alias("chrom"), _number(2, "long", "invalid start", strict).alias("start"), _number(3, "long", "invalid end", strict).alias("end")]
    row = F.struct(*cols, strip(_field(4)).alias("name"), _number(5, score, "invalid score", strict).alias("score"), F.when(strand != "", strand).alias("strand"))
    return df.select(F.inline(F.array(row)))  # each field is parsed once, whatever is built on it


def read_bed(spark: SparkSession, path: str | list[str], score: str = "long", drop_after: int | None = None, strict: bool = True, skip_headers: bool = False) -> DataFrame:
    """BED files. ``skip_headers`` leaves out comment, ``track`` and ``browser`` lines, which else fail as records."""
    df = lines(spark, path)
    if skip_headers:
        df = df.where("not (value like '#%' or value like 'track %' or value like 'browser %')")
    return parse_bed(df, score, drop_after, strict)


def parse_wig(df: DataFrame, score: str = "double") -> DataFrame:
    df = df.withColumn("f", F.split(F.trim("value"), r"\s+"))
    df = df.where(F.when(F.size("f") >= 4, True).otherwise(_fail("fewer than four fields", F.col("value"), "boolean")))
    return df.select(F.get("f", F.lit(0)).alias("chrom"), _number(2, "long", "invalid start", True).alias("start"), _number(3, "long", "invalid end", True).alias("end"), _number(4, score, "invalid score", True).alias("score"))


def read_wig(spark: SparkSession, path: str | list[str], score: str = "double") -> DataFrame:
    """Four-column WIG: chrom, start, end, score."""
    return parse_wig(lines(spark, path), score)


def read_wig_any(spark: SparkSession, path: str | list[str], score: str = "double") -> DataFrame:
    """WIG files of either form; each file is what its first line says, and an empty one is left out."""
    from spanloom.sources.blocks import read_fixed_wig

    raw = spark.read.text(path).where("value rlike '\\\\S'").select(F.col(PATH).alias("p"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.left("value", F.lit(9)).alias("v")).alias("line"))
    kinds = raw.groupBy("p").agg(F.min_by("line.v", F.struct("line.b", "line.i")).alias("v")).collect()
    fixed, rest = [r.p for r in kinds if r.v == "fixedStep"], [r.p for r in kinds if r.v != "fixedStep"]
    parts = ([read_fixed_wig(spark, fixed, score)] if fixed else []) + ([read_wig(spark, rest, score)] if rest else [])
    if not parts:
        return spark.createDataFrame([], f"chrom string, start long, end long, score {score}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_wig_directory(spark: SparkSession, path: str, chroms: list[str] | None = None, extension: str = "wig") -> DataFrame:
    """A directory with one file per chromosome; with ``chroms`` only those files are opened."""
    at = [f"{path}/{c}.{extension}" for c in chroms] if chroms else f"{path}/*.{extension}"
    return read_wig_any(spark, at)


def read_table(spark: SparkSession, path: str, header: bool = True, sep: str = "\t") -> DataFrame:
    """A delimited table, all strings. Leading and trailing empty columns are kept, blank lines skipped, ragged rows fail.

    The header is the first line of the first file by name, and is left out wherever a file begins with it; without one,
    columns are c1, c2, ... ``ord`` gives the order of a file's rows.
    """
    raw = spark.read.text(path)
    text = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).where("value <> ''").withColumn("ord", F.monotonically_increasing_id())
    firsts = (spark.read.text(f).where("value <> ''").first() for f in sorted(raw.inputFiles()))
    first = next((x for x in firsts if x is not None), None)
    if first is None:
        raise ValueError(f"empty table {path}")
    names = first.value.split(sep)
    n = len(names)
    rows = text.withColumn("f", F.split("value", f"\\Q{sep}\\E", -1))
    if header:
        # each file's first line, if it is the header: a table may be stored in several files, a file read in several blocks
        heads = text.groupBy("_file").agg(F.min_by(F.struct("ord", "value"), F.struct("_block", "ord")).alias("h")).where(F.col("h.value") == first.value)
        rows = rows.join(F.broadcast(heads.select(F.col("h.ord").alias("_head"))), F.col("ord") == F.col("_head"), "left_anti")
    else:
        names = [f"c{i}" for i in range(1, n + 1)]
    rows = rows.where(F.when(F.size("f") == n, True).otherwise(_fail("ragged row", F.col("value"), "boolean")))
    # a generator, so that no later filter is evaluated on header lines
    fields = F.struct(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)])
    return rows.select("ord", F.inline(F.array(fields))).select(*[f"`{c}`" for c in names], "ord")


def read_exon_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, count from two-column lines, or from BED lines with a name and a score."""
    df = lines(spark, path).withColumn("f", F.split("value", "\t"))
    n = F.size("f")
    name = F.when(n == 2, _field(1)).when(n == 6, _field(4)).otherwise(_fail("neither two columns nor BED", F.col("value"), "string"))
    return df.select(strip(name).alias("name"), F.when(n == 2, F.trim(_field(2)).cast("long")).otherwise(F.trim(_field(5)).cast("long")).alias("count"))


def _bare(i: Column) -> Column:
    return F.regexp_replace(i, "[()]", "").cast("long")


def parse_repeats(df: DataFrame) -> DataFrame:
    """Repeat annotation lines: place, strand, repeat, family, consensus place and length, id.

    Fifteen fields, or fourteen without the id; ends become exclusive, starts stay as they are. On the complement the
    consensus columns come in the opposite order.
    """
    df = df.withColumn("f", F.split(F.trim("value"), r"\s+"))
    df = df.where(F.when(F.size("f").isin(14, 15), True).otherwise(_fail("not 14 or 15 fields", F.col("value"), "boolean")))
    g = lambda i: F.get("f", F.lit(i))
    neg = g(8).isin("C", "-")
    left = F.when(neg, _bare(g(11))).otherwise(_bare(g(13)))
    end = g(12).cast("long") + 1
    return df.select(
        g(4).alias("chrom"), g(5).cast("long").alias("start"), (g(6).cast("long") + 1).alias("end"), F.when(neg, "-").otherwise("+").alias("strand"),
        g(0).cast("double").alias("score"), g(9).alias("name"), g(10).alias("family"),
        F.when(neg, _bare(g(13))).otherwise(_bare(g(11))).alias("c_start"), end.alias("c_end"), (end + left).alias("c_len"), F.try_element_at("f", F.lit(15)).alias("uniq_id"),
    )


def read_repeats(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """Repeat annotations; the two header lines of each file are told by their first word."""
    df = lines(spark, path)
    return parse_repeats(df.where("trim(value) rlike '^[0-9]'") if header else df)


def names_match(a: Column, b: Column) -> Column:
    """Two names of a repeat alignment agree if one begins with the other."""
    n = F.least(F.length(a), F.length(b))
    return F.left(a, n) == F.left(b, n)


def with_alignments(annotations: DataFrame, alignments: DataFrame) -> DataFrame:
    """``annotations`` with ``alignment``, a struct of the repeat alignment of the same uniq_id; null where there is none."""
    rows = alignments.select(F.col("uniq_id").alias("_u"), F.struct(*[c for c in alignments.columns if c != "uniq_id"]).alias("alignment"))
    return annotations.join(rows, F.col("uniq_id") == F.col("_u"), "left").drop("_u")


def read_enrichment(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Enrichment tables of 13 tab-separated fields with a header: category, identifier, name, pvalue (corrected)."""
    df = spark.read.text(path).where("value rlike '\\\\S'").withColumn("f", F.split("value", "\t", -1))
    df = df.where("not (f[0] = 'Category' and f[1] = 'Term')")
    df = df.where(F.when(F.size("f") == 13, True).otherwise(_fail("not 13 fields", F.col("value"), "boolean")))
    term = F.get("f", F.lit(1))
    return df.select(F.get("f", F.lit(0)).alias("category"), F.when(F.instr(term, "~") > 0, F.substring_index(term, "~", 1)).alias("identifier"), F.regexp_replace(term, "^[^~]*~", "").alias("name"), F.get("f", F.lit(11)).cast("double").alias("pvalue"))
