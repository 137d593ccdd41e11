"""Graphs in files: nodes as Parquet with a header beside them, lists of graphs by colour.

A graph's folder holds nodes (kmer, colour, covg, edges) and a header, one row a
colour: version, k, colour, sample, mean read length, bases loaded, error rate
and what cleaning was done.  Loading checks the version and k first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import check_k
from ..operators.graph import merge, new_only, nodes_type, overlap_with_clean, union_of_colours

VERSION = 1
HEADER = "version int, k int, colour string, sample string, mean_read_len long, total_seq long, error_rate double, tips_clipped boolean, supernode_threshold int, kmer_threshold int, cleaned_against string"


def header_of(spark: SparkSession, k: int, colours: list[str], metadata: DataFrame | None = None, **cleaning) -> DataFrame:
    """A header for colours, with (sample, total_seq, mean_read_len) of those in metadata; cleaning: other columns of HEADER."""
    names = [f.split()[0] for f in HEADER.split(", ")]
    rows = [tuple({"version": VERSION, "k": check_k(k), "colour": c, "sample": c, "error_rate": 0.01, "tips_clipped": False}.get(n, None) if n not in cleaning else cleaning[n] for n in names) for c in colours]
    out = spark.createDataFrame(rows, HEADER)
    if metadata is None:
        return out
    known = metadata.select(F.col("sample").alias("colour"), F.col("total_seq").cast("long").alias("_t"), F.col("mean_read_len").cast("long").alias("_m"))
    joined = out.join(known, "colour", "left").withColumns({"total_seq": F.coalesce("_t", "total_seq"), "mean_read_len": F.coalesce("_m", "mean_read_len")})
    return joined.select(*names)


def save(nodes: DataFrame, header: DataFrame, path: str, by_colour: bool = False) -> None:
    """Write a graph; by_colour: a folder for each colour, so that one of them can be read alone.  Nodes without coverage and edges are not kept."""
    out = nodes.where("covg > 0 OR edges <> 0").write.mode("errorifexists")
    (out.partitionBy("colour") if by_colour else out).parquet(f"{path}/nodes")
    header.coalesce(1).write.mode("errorifexists").parquet(f"{path}/header")


def check_header(header: DataFrame, k: int) -> None:
    """An error if the header has no row, another version or another k."""
    rows = header.select("version", "k").distinct().limit(3).collect()
    if not rows:
        raise ValueError("a graph without a header")
    for row in rows:
        if row["version"] != VERSION:
            raise ValueError(f"graph version {row['version']}, not {VERSION}")
        if row["k"] != k:
            raise ValueError(f"the graph has k = {row['k']}, not {k}")


def load(spark: SparkSession, path: str, k: int, colours: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, header) of a graph, of all its colours or some."""
    header = spark.read.schema(HEADER).parquet(f"{path}/header")
    check_header(header, k)
    nodes = spark.read.schema(nodes_type(k)).parquet(f"{path}/nodes").select("kmer", "colour", "covg", "edges")
    if colours is not None:
        nodes, header = nodes.where(F.col("colour").isin(colours)), header.where(F.col("colour").isin(colours))
    return nodes, header


def _lines(spark: SparkSession, path: str) -> list[list[str]]:
    """The cells of a list's lines, relative paths made whole; a list has a line for each file or colour."""
    base = path.rsplit("/", 1)[0]
    whole = lambda p: p if "://" in p or p.startswith("/") else f"{base}/{p}"
    rows = spark.read.text(path, wholetext=True).first()
    found = [line.split("\t") for line in (rows[0] if rows else "").split("\n") if line.strip()]
    return [[whole(cells[0].strip()), *[c.strip() for c in cells[1:]]] for cells in found]


def _one_colour(spark: SparkSession, paths: list[str], k: int, colour: str, union: bool) -> DataFrame:
    """Graphs laid together as one colour; union: a k-mer's coverage is that of the first graph that has it."""
    parts = [union_of_colours(load(spark, p, k)[0]).withColumn("colour", F.lit(colour)).select("kmer", "colour", "covg", "edges") for p in paths]
    return reduce(new_only, parts) if union else merge(reduce(DataFrame.unionByName, parts))


def load_colours(spark: SparkSession, path: str, k: int, union: bool = False, clean: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, samples): line n of a list names a list of graphs that are colour n; a sample's name may follow a tab.

    clean: a graph (kmer, edges); only its k-mers are loaded, with the edges that it has too.
    """
    out, samples = None, []
    for n, (listed, *name) in enumerate(_lines(spark, path)):
        one = _one_colour(spark, [cells[0] for cells in _lines(spark, listed)], k, str(n), union)
        one = one if clean is None else overlap_with_clean(one, clean)
        out = one if out is None else out.unionByName(one)
        samples.append((str(n), name[0] if name else f"sample_{n}"))
    if out is None:
        raise ValueError(f"no colours in {path}")
    return out, spark.createDataFrame(samples, "colour string, sample string")


def load_multicolour_then(spark: SparkSession, path: str, k: int, more: str | None = None) -> DataFrame:
    """The colours of a graph file, then those of a list, numbered on from them."""
    nodes, header = load(spark, path, k)
    if more is None:
        return nodes
    first = header.count()
    rest, _ = load_colours(spark, more, k)
    return nodes.unionByName(rest.withColumn("colour", (F.col("colour").cast("int") + first).cast("string")))


def dump_cleaned_colours(spark: SparkSession, path: str, k: int, clean: DataFrame, folder: str, suffix: str) -> list[str]:
    """Each colour of a list, less what a clean graph does not have, as a graph of its own; the folders written."""
    out = []
    for n, (listed, *name) in enumerate(_lines(spark, path)):
        one = overlap_with_clean(_one_colour(spark, [cells[0] for cells in _lines(spark, listed)], k, str(n), False), clean)
        sample = name[0] if name else f"sample_{n}"
        save(one, header_of(spark, k, [str(n)], sample=sample, cleaned_against=suffix), f"{folder}/{sample}_{suffix}")
        out.append(f"{folder}/{sample}_{suffix}")
    return out


def load_summary(header: DataFrame) -> DataFrame:
    """(colour, sample, mean_read_len, total_seq, error_rate, cleaning): what the graph was made of."""
    said = F.concat_ws(", ", F.when(F.col("tips_clipped"), "tips clipped"), F.when(F.col("supernode_threshold").isNotNull(), F.concat(F.lit("supernodes of at most "), "supernode_threshold", F.lit(" removed"))), F.when(F.col("kmer_threshold").isNotNull(), F.concat(F.lit("k-mers of at most "), "kmer_threshold", F.lit(" removed"))), F.when(F.col("cleaned_against").isNotNull(), F.concat(F.lit("cleaned against "), "cleaned_against")))
    return header.select("colour", "sample", "mean_read_len", "total_seq", "error_rate", F.when(said == "", "none").otherwise(said).alias("cleaning"))
