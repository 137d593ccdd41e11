"""Reads from FASTA, FASTQ, plain, SAM and BAM files, from lists of files, and from tables of prose."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dna import text_to_dna

READS = "sample string, file string, read_id long, mate int, name string, seq string, qual string"


def _records(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """(file, n, value): the records of text files, numbered from 0 within each file.

    Files are split wherever Spark splits them.  A first pass counts the records
    of each split; a record's number is those of the splits before it and its
    place in its own, so no task sees a whole file.
    """
    read = spark.read.text(path, lineSep=separator)
    rows = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "at").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    before = F.sum("size").over(Window.partitionBy("file").orderBy("at")) - F.col("size")
    return rows.join(splits.select("file", "at", "least", before.alias("before")), ["file", "at"]).select("file", (F.col("before") + F.col("id") - F.col("least")).alias("n"), "value")


def _read(file: str, read_id: Column, name: Column, seq: Column, qual: Column, sample: str, mate: int) -> list[Column]:
    return [F.lit(sample).alias("sample"), F.col(file).alias("file"), read_id.cast("long").alias("read_id"), F.lit(mate).alias("mate"), name.alias("name"), seq.alias("seq"), qual.cast("string").alias("qual")]


def read_fasta(spark: SparkSession, path: str | list[str], sample: str = "0", mate: int = 0) -> DataFrame:
    """Entries of any number of lines, in any case; gzip by the file's name.  A record is an entry."""
    entry = F.regexp_replace("value", "^>", "")
    rows = _records(spark, path, "\n>").withColumn("entry", entry).where("trim(entry) <> ''")
    name = F.rtrim(F.regexp_replace(F.substring_index("entry", "\n", 1), "\r", ""))
    seq = F.when(F.instr("entry", "\n") > 0, F.regexp_replace(F.expr("substring(entry, instr(entry, '\n') + 1)"), "\\s", "")).otherwise("")
    return rows.select(*_read("file", F.col("n"), name, seq, F.lit(None), sample, mate))


def read_fastq(spark: SparkSession, path: str | list[str], sample: str = "0", mate: int = 0) -> DataFrame:
    """Records of four lines; those whose quality is not as long as the sequence are dropped."""
    lines = _records(spark, path, "\n").select("file", F.expr("n div 4").alias("i"), F.expr("n % 4").alias("part"), F.rtrim(F.regexp_replace("value", "\r", "")).alias("v"))
    cell = lambda k: F.max(F.when(F.col("part") == k, F.col("v")))
    found = lines.groupBy("file", "i").agg(cell(0).alias("h"), cell(1).alias("s"), cell(2).alias("p"), cell(3).alias("q"))
    whole = found.where((F.length("s") == F.length("q")) & F.startswith("h", F.lit("@")) & F.startswith("p", F.lit("+")))
    return whole.select(*_read("file", F.col("i"), F.expr("substring(h, 2)"), F.col("s"), F.col("q"), sample, mate))


def read_plain(spark: SparkSession, path: str | list[str], sample: str = "0", mate: int = 0) -> DataFrame:
    """One sequence a line."""
    return _records(spark, path, "\n").where("trim(value) <> ''").select(*_read("file", F.col("n"), F.lit(""), F.trim(F.regexp_replace("value", "\r", "")), F.lit(None), sample, mate))


def _sequenced(rows: DataFrame, sample: str, mate: int) -> DataFrame:
    """Reads of alignments (file, n, name, flag, seq, qual): the primary ones, in the strand they were sequenced on."""
    back = F.col("flag").bitwiseAND(F.lit(16)) != 0
    seq = F.when(back, F.reverse(F.translate("seq", "ACGTacgt", "TGCATGCA"))).otherwise(F.col("seq"))
    qual = F.when(F.col("qual") != "*", F.when(back, F.reverse("qual")).otherwise(F.col("qual")))
    return rows.where(F.col("flag").bitwiseAND(F.lit(0x900)) == 0).select(*_read("file", F.col("n"), F.col("name"), seq, qual, sample, mate))


def read_sam(spark: SparkSession, path: str | list[str], sample: str = "0", mate: int = 0) -> DataFrame:
    """Primary alignments' reads, in the strand they were sequenced on."""
    c = F.split(F.regexp_replace("value", "\r", ""), "\t")
    lines = _records(spark, path, "\n").where("value <> '' AND value NOT LIKE '@%'")
    return _sequenced(lines.select("file", "n", c[0].alias("name"), c[1].cast("int").alias("flag"), c[9].alias("seq"), c[10].alias("qual")), sample, mate)


def _alignments(data: bytes) -> Iterator[tuple[str, int, str, str]]:
    """(name, flag, seq, qual) of each record of an unpacked BAM file."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    word = struct.Struct("<i").unpack_from
    at = 8 + word(data, 4)[0]
    n_refs, at = word(data, at)[0], at + 4
    for _ in range(n_refs):
        at += 8 + word(data, at)[0]
    while at < len(data):
        size = word(data, at)[0]
        n_name, n_cigar, flag, n_seq = data[at + 12], *struct.unpack_from("<HHi", data, at + 16)
        body = at + 36
        name = data[body : body + n_name - 1].decode()
        body += n_name + 4 * n_cigar
        packed = data[body : body + (n_seq + 1) // 2]
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in packed)[:n_seq]
        quals = data[body + len(packed) : body + len(packed) + n_seq]
        yield name, flag, seq, "*" if not quals or quals[0] == 255 else bytes(q + 33 for q in quals).decode()
        at += 4 + size


def read_bam(spark: SparkSession, path: str | list[str], sample: str = "0", mate: int = 0) -> DataFrame:
    """Primary alignments' reads of BAM files, as of SAM files.  A file, which is packed in blocks without marks between records, is read by one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _alignments(gzip.decompress(data))
                start = 0
                while part := list(islice(found, 1 << 14)):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), len(part)), pa.array(range(start, start + len(part)), pa.int64()), *[pa.array([p[i] for p in part], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))]], ["file", "n", "name", "flag", "seq", "qual"])
                    start += len(part)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _sequenced(files.mapInArrow(run, "file string, n long, name string, flag int, seq string, qual string"), sample, mate)


def sniffed(spark: SparkSession, path: str) -> str:
    """fasta, fastq, sam, bam or plain, by how the first file of a path begins."""
    files = spark.read.format("binaryFile").load(path)
    head = files.orderBy("path").select(F.substring("content", 1, 1 << 16).alias("head")).first()
    head = bytes(head["head"]) if head is not None else b""
    if head[:2] == b"\x1f\x8b":
        head = zlib.decompressobj(31).decompress(head, 1 << 16)
    if head[:4] == b"BAM\1":
        return "bam"
    first = next((line for line in head.split(b"\n") if line.strip()), b"")
    if first[:1] == b">":
        return "fasta"
    if first[:1] == b"@":
        return "sam" if re.match(rb"@(HD|SQ|RG|PG|CO)\t", first) else "fastq"
    return "sam" if len(first.split(b"\t")) >= 11 else "plain"


READERS = {"fasta": read_fasta, "fastq": read_fastq, "sam": read_sam, "bam": read_bam, "plain": read_plain}


def read_any(spark: SparkSession, path: str, sample: str = "0", mate: int = 0) -> DataFrame:
    """Reads of a file in whichever of the formats it is."""
    return READERS[sniffed(spark, path)](spark, path, sample, mate)


def read_list(spark: SparkSession, path: str, reader=read_any, **kw) -> DataFrame:
    """The files that a list names, one a line, relative to the list; a sample may follow a tab."""
    base = path.rsplit("/", 1)[0]
    found = None
    for row in spark.read.text(path).where("trim(value) <> ''").collect():  # a row for each file
        name, _, sample = row[0].partition("\t")
        file = name if "://" in name or name.startswith("/") else f"{base}/{name}"
        one = reader(spark, file.strip(), **kw | ({"sample": sample.strip()} if sample.strip() else {}))
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], READS)


def pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by their position; unequal numbers of reads are an error when the rows are read."""
    a = first.select("sample", F.col("read_id"), F.struct("name", "seq", "qual").alias("mate1"))
    b = second.select("read_id", F.struct("name", "seq", "qual").alias("mate2"))
    both = a.join(b, "read_id", "full_outer")
    odd = F.col("mate1").isNull() | F.col("mate2").isNull()
    return both.withColumn("mate1", F.when(odd, F.raise_error(F.lit("the mates' files have unequal numbers of reads"))).otherwise(F.col("mate1")))


def subsample(reads: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Each read with probability p, mates together, the same rows whenever it runs."""
    return reads.where(F.pmod(F.xxhash64(F.lit(seed), "sample", "read_id"), F.lit(1_000_000)) < int(p * 1_000_000))


def reads_of_prose(docs: DataFrame, sample: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A read for each document; see text_to_dna."""
    return docs.select(F.col(sample).cast("string").alias("sample"), F.lit("").alias("file"), F.col(id_col).cast("long").alias("read_id"), F.lit(0).alias("mate"), F.lit("").alias("name"), text_to_dna(F.col(text_col)).alias("seq"), F.lit(None).cast("string").alias("qual"))


def fasta(rows: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """Lines of a FASTA file, to be written as text."""
    return rows.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))
