"""Block formats: FASTA, FASTQ, fixed-step WIG, MAF, repeat alignments.

Where a record's first line can be told by itself (FASTA, MAF), the file is read with that as the line separator, so it
is still split, fixed-step WIG at its headers. Four-line FASTQ is read in byte ranges that find their first record. Repeat
alignments and wrapped or compressed FASTQ are read a file at a time; give such data as many files. Parsers are generators over Arrow batches.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.sources.text import PATH

#: Fixed value: symbols of a repeat alignment's middle line.
ANNOTATION = set("-iv? ")


class FormatError(ValueError):
    pass


def _parsed(df: DataFrame, schema: str, parse: Callable[[str, str], Iterable[tuple]]) -> DataFrame:
    """Rows that ``parse(path, text)`` gives for each row (path, value)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind: StructType = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        names, out = kind.names, []
        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in parse(p, t):
                    out.append(dict(zip(names, row)))
                    if len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, arrow)
                        out = []
        yield pa.RecordBatch.from_pylist(out, arrow)

    return df.mapInArrow(run, kind)


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col(PATH).alias("p"), "value")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name, seq: ``>`` lines begin a record, its other lines are joined. The file is split at records."""
    df = spark.read.option("lineSep", "\n>").text(path).where("value rlike '\\\\S'")
    rec = F.regexp_replace("value", "^>", "")
    name = F.trim(F.regexp_extract(rec, "^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace(rec, "^[^\n]*\n?", ""), r"\s", "")
    return df.select(name.alias("name"), seq.alias("seq"))


def count_sequences(spark: SparkSession, path: str | list[str]) -> int:
    return spark.read.text(path).where("value like '>%'").count()


def parse_fastq(text: str, allow_mismatch: bool = False) -> Iterator[tuple[str, str, str]]:
    """Records of four non-blank lines."""
    rows = [x for x in (y.rstrip("\r") for y in text.split("\n")) if x.strip()]
    if len(rows) % 4:
        raise FormatError("truncated record")
    for i in range(0, len(rows), 4):
        a, seq, b, qual = rows[i : i + 4]
        name, again = a[1:].strip(), b[1:].strip()
        if name != again and not allow_mismatch:
            raise FormatError(f"names differ: {name} and {again}")
        if len(seq.strip()) != len(qual.strip()):
            raise FormatError(f"sequence and quality differ in length: {name}")
        yield name, seq.strip(), qual.strip()


def parse_fastq_wrapped(text: str) -> Iterator[tuple[str, str, str]]:
    """Records whose sequence and quality may take several lines; the quality ends when it is as long as the sequence,
    so quality lines may begin with ``@``."""
    rows = iter([x for x in (y.strip() for y in text.split("\n")) if x])
    for x in rows:
        if not x.startswith("@"):
            raise FormatError(f"no record begins with {x[:20]}")
        name, seq, qual = x[1:].strip(), "", ""
        for y in rows:
            if y.startswith("+"):
                break
            seq += y
        while len(qual) < len(seq):
            nxt = next(rows, None)
            if nxt is None:
                raise FormatError(f"truncated record {name}")
            qual += nxt
        if len(qual) != len(seq):
            raise FormatError(f"sequence and quality differ in length: {name}")
        yield name, seq, qual


def _ranges(spark: SparkSession, path: str | list[str], size: int) -> DataFrame:
    """path, at: byte ranges of ``size`` of the files, one partition each; only the files' lengths are listed."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    n = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1
    return files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("at")).repartition(int(n))


def _opened(path: str) -> tuple:
    """The store of a path and its name there; a path without a scheme is a shared folder's."""
    from pyarrow import fs

    local = path.removeprefix("file://").removeprefix("file:")
    return (fs.LocalFileSystem(), local) if local.startswith("/") and "://" not in local else fs.FileSystem.from_uri(path)


def _records_from(path: str, at: int, size: int) -> Iterator[list[str]]:
    """The four-line records that begin in [at, at + size) of a file; the last one may end beyond it.

    A record begins at a line with ``@`` whose second next line has ``+``: a quality line that begins with ``@`` is
    followed by a name and a sequence, and no sequence begins with ``+``.
    """
    system, name = _opened(path)
    with system.open_input_file(name) as raw:
        begin = max(0, at - 1)
        raw.seek(begin)
        f = io.BufferedReader(raw, 1 << 20)
        place = begin
        if at:
            place += len(f.readline())  # the rest of a line that an earlier range has
        lines: list[tuple[int, str]] = []

        def more() -> bool:
            nonlocal place
            while x := f.readline():
                here, place = place, place + len(x)
                text = x.decode("utf-8").rstrip("\r\n")
                if text.strip():
                    lines.append((here, text))
                    return True
            return False

        while more() and len(lines) < 3:
            pass
        if at:
            while len(lines) >= 3 and not (lines[0][1].startswith("@") and lines[2][1].startswith("+")):
                lines.pop(0)
                if lines[0][0] >= at + size or not more():
                    break
            if len(lines) == 2 and lines[0][0] < at + size and lines[0][1].startswith("@"):  # the rest of a whole record never looks so
                yield [x for _, x in lines]
            if len(lines) < 3 or not (lines[0][1].startswith("@") and lines[2][1].startswith("+")):
                return
        while lines and lines[0][0] < at + size:
            while len(lines) < 4 and more():
                pass
            yield [x for _, x in lines[:4]]
            del lines[:4]
            if not lines and not more():
                return


def read_fastq(spark: SparkSession, path: str | list[str], allow_mismatch: bool = False, wrapped: bool = False, range_bytes: int = 64 << 20) -> DataFrame:
    """name, seq, qual. A bare ``+`` line only passes with ``allow_mismatch`` (or ``wrapped``).

    Four-line files are read in ranges of ``range_bytes``, each finding its own first record. Compressed files and records
    over several lines (``wrapped``) can't be entered midway; those are read a file at a time.
    """
    if wrapped or any(f.endswith((".gz", ".bz2", ".zst")) for f in spark.read.text(path).inputFiles()):
        parse = (lambda p, t: parse_fastq_wrapped(t)) if wrapped else (lambda p, t: parse_fastq(t, allow_mismatch))
        return _parsed(_whole(spark, path), "name string, seq string, qual string", parse)
    rows = _ranges(spark, path, range_bytes).select(F.col("path").alias("p"), F.col("at").cast("string").alias("value"))

    def records(p: str, at: str) -> Iterator[tuple[str, str, str]]:
        for rows in _records_from(p, int(at), range_bytes):
            yield from parse_fastq("\n".join(rows), allow_mismatch)

    return _parsed(rows, "name string, seq string, qual string", records)


def parse_fixed_wig(text: str) -> Iterator[tuple[str, int, int, float]]:
    """``fixedStep chrom= start= step=`` headers, then one value a line; the n-th is [start + n step, start + (n+1) step)."""
    chrom, at, step = None, 0, 1
    for x in text.split("\n"):
        x = x.strip()
        if not x or x.startswith(("track", "#")):
            continue
        if x.startswith("fixedStep"):
            opts = dict(y.split("=", 1) for y in x.split()[1:])
            chrom, at, step = opts["chrom"], int(opts["start"]), int(opts.get("step", 1))
            if "span" in opts and int(opts["span"]) != step:
                raise FormatError("a span other than the step is not supported")
        elif x.startswith("variableStep"):
            raise FormatError("variableStep is not supported")
        elif chrom is None:
            raise FormatError("value before a fixedStep header")
        else:
            yield chrom, at, at + step, float(x)
            at += step


def read_fixed_wig(spark: SparkSession, path: str | list[str], score: str = "double") -> DataFrame:
    # a header begins a run of its own, so files are split there
    runs = spark.read.option("lineSep", "\nfixedStep").text(path).select(F.col(PATH).alias("p"), F.when(F.col("value").rlike(r"\A\s+chrom="), F.concat(F.lit("fixedStep"), "value")).otherwise(F.col("value")).alias("value"))
    out = _parsed(runs, "chrom string, start long, end long, score double", lambda p, t: parse_fixed_wig(t))
    return out.withColumn("score", F.col("score").cast(score))


MAF = "block string, ord int, name string, seq string, start long, end long, strand string, remaining long, meta map<string,string>, block_meta map<string,string>"


def parse_maf(where: str, text: str) -> Iterator[tuple]:
    """Sequences of one block, or of several. Lines: ``a`` k=v of the block, ``s`` sequence, ``i`` context, ``e`` empty,
    ``q`` quality. Places on the negative strand become places on the positive one."""
    block, seqs, meta, n = None, [], {}, 0

    def close() -> Iterator[tuple]:
        if block is not None:
            for i, s in enumerate(seqs):
                yield (block, i, s["name"], s["seq"], s["start"], s["end"], s["strand"], s["rest"], s["meta"], meta)

    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line.strip() or line.startswith(("#", "track")):
            continue
        p = line.split()
        if p[0] == "a":
            yield from close()
            block, seqs, n = f"{where}:{n}", [], n + 1
            meta = dict(x.split("=", 1) for x in p[1:] if "=" in x)
        elif p[0] in ("s", "e"):
            name, start, size, strand, total = p[1], int(p[2]), int(p[3]), p[4], int(p[5])
            end, rest = start + size, total - start - size
            if strand == "-":
                start, end, rest = total - end, total - start, start
            seqs.append({"name": name, "seq": p[6] if p[0] == "s" else None, "start": start, "end": end, "strand": strand, "rest": rest, "meta": {} if p[0] == "s" else {"empty": p[6]}})
        elif p[0] in ("i", "q"):
            if not seqs or seqs[-1]["name"] != p[1]:
                raise FormatError(f"{p[0]} line without its sequence: {line[:40]}")
            if p[0] == "q":
                seqs[-1]["meta"]["quality"] = p[2]
            else:
                seqs[-1]["meta"].update(zip(("left_status", "left_count", "right_status", "right_count"), p[2:6], strict=True))
        else:
            raise FormatError(f"unknown line type {p[0]}")
    yield from close()


def read_maf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per block and sequence; the file is split at blocks. A block's id is its file, the split it was read in and
    its number there, so equal blocks stay apart."""
    df = spark.read.option("lineSep", "\na").text(path)
    body = F.when(F.col("value").rlike("^a?[ \t]*(\r?\n|[^\n#]*=)") & ~F.col("value").startswith("##"), F.concat(F.lit("a "), F.regexp_replace("value", "^a(?=[ \t\r\n])", "")))
    # what stands before the first block is the preamble; a file may also begin with a block
    rows = df.select(F.concat_ws("#", F.substring_index(F.col(PATH), "/", -1), F.col("_metadata.file_block_start").cast("string"), F.monotonically_increasing_id().cast("string")).alias("p"), F.coalesce(body, F.col("value")).alias("value"))
    return _parsed(rows, MAF, lambda p, t: parse_maf(p, t) if t.startswith("a") or "\na" in t else iter(()))


def genome_alignment(spark: SparkSession, path: str, reference: str, extensions: list[str] | None = None) -> DataFrame:
    """MAF blocks of a file, or of the files of a directory with one of the extensions (with or without the dot)."""
    from spanloom.operators.alignment import genome_blocks

    at = path if not extensions else [f"{path}/*.{e.lstrip('.')}" for e in extensions]
    rows = read_maf(spark, at)
    place = genome_blocks(rows, reference).withColumnsRenamed({"chrom": "ref_chrom", "start": "ref_start", "end": "ref_end"})
    return rows.join(place, "block")


LOCUS = re.compile(r"^(?P<chrom>[^:]+?)(?::(?P<start>\d+)-(?P<end>\d+))?\.(?P<ext>[^.]+)$")


def locus_files(files: list[str], extensions: list[str] | None = None) -> list[tuple[str, str, int | None, int | None]]:
    """(path, chrom, start, end) by file names ``chrom.ext`` or ``chrom:start-end.ext``; a locus twice is an error."""
    out, seen = [], set()
    for f in files:
        m = LOCUS.match(f.rsplit("/", 1)[-1])
        if not m or (extensions and m["ext"] not in {e.lstrip(".") for e in extensions}):
            continue
        key = (m["chrom"], m["start"], m["end"])
        if key in seen:
            raise FormatError(f"two files for locus {key}")
        seen.add(key)
        out.append((f, m["chrom"], int(m["start"]) if m["start"] else None, int(m["end"]) if m["end"] else None))
    return out


def read_locus_alignment(spark: SparkSession, files: list[str], chrom: str, start: int, end: int, extensions: list[str] | None = None) -> DataFrame:
    """Only the files whose name says that they hold part of the wanted place are opened."""
    hit = [f for f, c, s, e in locus_files(files, extensions) if c == chrom and (s is None or (s < end and e > start))]
    plain, odd = [f for f in hit if ":" not in f.rsplit("/", 1)[-1]], [f for f in hit if ":" in f.rsplit("/", 1)[-1]]
    parts = [read_maf(spark, plain)] if plain else []
    if odd:
        # Hadoop's file systems refuse names with a colon, so the workers open those themselves, on whatever store they are
        def opened(path: str, _: str) -> Iterator[tuple]:
            system, name = _opened(path)
            with system.open_input_stream(name) as f:
                yield from parse_maf(path.rsplit("/", 1)[-1], f.read().decode("utf-8"))

        parts.append(_parsed(spark.createDataFrame([(f, "") for f in odd], "p string, value string").repartition(len(odd)), MAF, opened))
    if not parts:
        return spark.createDataFrame([], MAF)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


REPEAT_HEADER = re.compile(r"^\s*\d+\s+\d+\.\d+\s+\d+\.\d+\s+\d+\.\d+\s")
REPEAT_LINE = re.compile(r"^(?P<c>C?)\s*(?P<name>\S+)\s+(?P<from>\d+)\s+(?P<seq>[A-Za-z\-]+)\s+(?P<to>\d+)\s*$")
REPEATS = "uniq_id string, score double, q_name string, q_seq string, q_start long, q_end long, q_remaining long, r_name string, r_seq string, r_start long, r_end long, r_remaining long, r_strand string, annotation string, meta map<string,string>"


def _paren(x: str) -> int:
    return int(x.strip("()"))


def parse_repeat_alignments(text: str) -> Iterator[tuple]:
    """Pairwise alignments of genome and repeat: header, triplets of (genome, marks, repeat) lines, ``key = value`` lines.

    Ends become exclusive and starts smaller than ends, whatever the strand.
    """
    head, q, r, marks, meta, indent = None, [], [], [], {}, 0
    waiting = 0

    def close() -> Iterator[tuple]:
        if head is None:
            return
        p = head.split()
        comp = p[8] == "C"
        rest = p[9:] if comp else p[8:]
        if len(rest) < 4 or len(p) not in (13, 14, 15):
            raise FormatError(f"bad header: {head[:60]}")
        name, x, y, z = rest[:4]
        if comp:
            left, hi, lo = _paren(x), int(y), int(z)
        else:
            lo, hi, left = int(x), int(y), _paren(z)
        info = {"substitutions": p[1], "deletions": p[2], "insertions": p[3], **meta}
        if len(rest) > 5:
            info["source"] = rest[4]
        yield (rest[-1] if len(rest) > 4 else None, float(p[0]), p[4], "".join(q), int(p[5]), int(p[6]) + 1, _paren(p[7]), name, "".join(r), lo, hi + 1, left, "-" if comp else "+", "".join(marks), info)

    for line in text.split("\n"):
        line = line.rstrip("\r\n")
        if REPEAT_HEADER.match(line):
            yield from close()
            head, q, r, marks, meta, waiting = line, [], [], [], {}, 0
        elif head is None:
            if line.strip():
                raise FormatError(f"line before a header: {line[:40]}")
        elif m := REPEAT_LINE.match(line):
            if waiting == 0:
                q.append(m["seq"])
                indent, width, waiting = m.start("seq"), len(m["seq"]), 1
            else:
                if waiting == 1:
                    marks.append(" " * width)
                r.append(m["seq"])
                if len(m["seq"]) != width:
                    raise FormatError("lines of a pair differ in length")
                waiting = 0
        elif waiting == 1:
            got = line[indent : indent + width].ljust(width)
            if set(got) - ANNOTATION:
                raise FormatError(f"unknown mark in {got!r}")
            marks.append(got)
            waiting = 2
        elif "=" in line:
            k, v = line.split("=", 1)
            meta[k.strip()] = v.strip()
    yield from close()


def read_repeat_alignments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _parsed(_whole(spark, path), REPEATS, lambda p, t: parse_repeat_alignments(t))
