"""The registered queries of the graph engine and their DuckDB SQL.

The tables hold no DNA: documents and benchmark items are turned into reads by
functions.dna.text_to_dna.  Queries read their tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import reverse_complement, unpacked
from ..operators import callset, correction, coverage, discovery, fastn, filters, genotype, graph, population, stretches, supernodes as nodes_on, unitigs, vcf
from ..sources.reads import reads_of_prose

K, K_PATHS, K_WIDE = 11, 15, 41
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _docs(spark: SparkSession, sf_dir: str, sample: str = "lang") -> DataFrame:
    return filters.contigs(reads_of_prose(spark.read.parquet(f"{sf_dir}/documents.parquet"), sample), K)


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(_docs(spark, sf_dir), K)


def _items(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("one", F.lit("all"))
    return filters.contigs(reads_of_prose(items, "one", "item_id"), k)


def _item_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitigs.written(graph.union_of_colours(graph.build(_items(spark, sf_dir, K_PATHS), K_PATHS)))


def covg_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.covg_distribution(_nodes(spark, sf_dir))


def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = graph.build(_items(spark, sf_dir, K_PATHS), K_PATHS)
    return items.select(unpacked(F.col("kmer"), K_PATHS).alias("kmer"), "covg", "edges")


def read_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.read_length_distribution(_docs(spark, sf_dir))


def sample_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sample_metadata(_docs(spark, sf_dir, "source"))


def homopolymer_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = reads_of_prose(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang")
    return filters.read_length_distribution(filters.contigs(reads, K, homopolymer=4))


def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_distribution(_nodes(spark, sf_dir))


def sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sharing(_nodes(spark, sf_dir))


def colour_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.colour_overlaps(_nodes(spark, sf_dir))


def pan_genome_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = _items(spark, sf_dir, K).select("read_id", "seq")
    return graph.pan_genome_matrix(genes, _nodes(spark, sf_dir), K, "read_id").select(F.col("id").alias("item_id"), "colour", "fraction", "least")


def wide_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(_items(spark, sf_dir, K_WIDE), K_WIDE).select("kmer", "covg", "edges")


def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' graph after its k-mers seen once are taken out and edges to them are left."""
    return graph.health_check(_item_graph(spark, sf_dir).where("covg > 1"), K_PATHS).groupBy("problem").agg(F.count("*").alias("n"))


def low_coverage_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees after k-mers of low coverage went: nodes and edges show."""
    return graph.degree_distribution(graph.remove_low_coverage(_nodes(spark, sf_dir), 2, K))


def supernodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitigs.once(unitigs.unitigs(_item_graph(spark, sf_dir), K_PATHS)).select("seq", "n_edges", "min_covg", "max_covg", "is_cycle")


def supernode_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitigs.n50(unitigs.once(unitigs.unitigs(_item_graph(spark, sf_dir), K_PATHS)), K_PATHS)


def clipped_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitigs.clip_tips(_item_graph(spark, sf_dir), K_PATHS).select(unpacked(F.col("kmer"), K_PATHS).alias("kmer"), "covg", "edges")


def cleaned_supernodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unitigs.remove_low_coverage_supernodes(_item_graph(spark, sf_dir), K_PATHS, 1).select(unpacked(F.col("kmer"), K_PATHS).alias("kmer"), "covg", "edges")


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return stretches.bubbles_of_reads(docs, K_PATHS, "text", stretches.PROSE).select("branch1", "branch2")


def item_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bubbles of the benchmark items laid together with the same items with two bases complemented."""
    return unitigs.bubbles(unitigs.written(graph.union_of_colours(_two_colours(spark, sf_dir))), K_PATHS).select("branch1", "branch2")


def supernode_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_on.junctions(unitigs.once(unitigs.unitigs(_item_graph(spark, sf_dir), K_PATHS)))


def supernode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_on.error_supernodes(unitigs.once(unitigs.unitigs(_item_graph(spark, sf_dir), K_PATHS)), 1)


def kmer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each k-mer of each item stands in all items."""
    return coverage.uniqueness(_chroms(spark, sf_dir), K, "chrom").select("id", F.col("pos").cast("long").alias("pos"), "times")


def item_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage of each k-mer of the items in the documents of each language."""
    found = graph.align(_chroms(spark, sf_dir), _nodes(spark, sf_dir), K, "chrom", ["en", "de", "fr", "es"])
    return found.select("id", F.col("pos").cast("long").alias("pos"), *[F.col(c).cast("long").alias(c) for c in ("en", "de", "fr", "es")])


def items_in_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of items whose k-mers and steps the English documents have."""
    own = _nodes(spark, sf_dir).where("colour = 'en'").select("kmer", "edges")
    return coverage.broken_at_graph(_chroms(spark, sf_dir), own, K, "chrom", True).select("id", F.col("start").cast("long").alias("start"), "seq")


def item_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.paths_in_colour(_chroms(spark, sf_dir), _nodes(spark, sf_dir), K, "chrom", "en")


def regenotyped_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change in the middle of each item genotyped among the items and among the changed ones."""
    sides = {"flank5p": "left(seq, length(seq) div 2)", "branch1": "substring(seq, length(seq) div 2 + 1, 2)", "branch2": "translate(substring(seq, length(seq) div 2 + 1, 2), 'ACGT', 'TGCA')", "flank3p": "substring(seq, length(seq) div 2 + 3)"}
    variants = _chroms(spark, sf_dir).select(F.col("chrom").alias("var_id"), *[F.expr(e).alias(c) for c, e in sides.items()])
    samples = spark.createDataFrame([("items", 200, 4000, 0.01), ("changed", 200, 4000, 0.01)], "colour string, mean_read_len long, total_seq long, error_rate double")
    found = genotype.regenotyped(variants, unitigs.written(_two_colours(spark, sf_dir)), samples, K_PATHS, 4000, genotype.DIVERGENCE)
    return found.select("var_id", "colour", *[F.col(c).cast("long").alias(c) for c in ("c1", "c2", "median1", "median2", "min1", "min2")], "gt", "gt_conf")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods over two read counts of each order line, as a test of the formulae."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sites = lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("c1"), F.expr("cast(l_suppkey % 30 AS long)").alias("c2"))
    return genotype.call(sites, F.lit(20.0), F.lit(20.0)).select("l_orderkey", "l_linenumber", "gt", "gt_conf")


def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of change between alleles that are cut from part names turned to DNA."""
    from ..functions.dna import text_to_dna

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    dna = text_to_dna(F.col("p_name"))
    calls = part.select(F.lit("c").alias("chrom"), F.col("p_partkey").alias("pos"), F.expr("cast(p_partkey AS string)").alias("id"), F.substring(dna, 1, 1).alias("ref"), F.substring(dna, F.lit(2), (F.col("p_partkey") % 3 + 1).cast("int")).alias("alt"))
    return vcf.summary(calls)


# Calls are made of order lines, features of parts and chromosomes of benchmark items; Spark and DuckDB read the same expressions.
_CALLS = {
    "chrom": "concat('chr', l_suppkey % 5 + 1)", "pos": "CAST(l_partkey * 7 + l_linenumber AS BIGINT)", "id": "concat(l_orderkey, '_', l_linenumber)",
    "ref": "substr('ACGTTGCAACGGT', CAST(l_quantity % 10 AS INTEGER) + 1, 1 + l_linenumber % 3)", "alt": "substr('CATGGTACCTTAG', CAST(l_orderkey % 10 AS INTEGER) + 1, CAST(1 + l_orderkey % 3 AS INTEGER))",
}
_FEATURES = {"chrom": "concat('chr', p_partkey % 5 + 1)", "start": "CAST(p_partkey * 7 AS BIGINT)", "stop": "CAST(p_partkey * 7 + p_size * 3 AS BIGINT)", "name": "concat('g', p_partkey)"}
_STEP, _FLANK = 37, 12


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    whole = rows.select(*[F.expr(e).alias(c) for c, e in _CALLS.items()])
    return whole.withColumns({"qual": F.lit("."), "filter": F.lit("PASS"), "info": F.create_map(F.lit("K"), F.length("ref").cast("string"))})


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(*[F.expr(e).alias(c) for c, e in _FEATURES.items()])


def _chroms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads_of_prose(spark.read.parquet(f"{sf_dir}/benchmark.parquet").withColumn("one", F.lit("all")), "one", "item_id").select(F.col("read_id").cast("string").alias("chrom"), "seq")


def _item_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change at every so many bases of each item."""
    at = _chroms(spark, sf_dir).where("length(seq) > 0").select("chrom", "seq", F.explode(F.expr(f"sequence(1, length(seq), {_STEP})")).alias("p"))
    return at.select("chrom", F.col("p").cast("long").alias("pos"), F.expr("concat(chrom, '_', p)").alias("id"), F.expr("substring(seq, p, 1 + p % 3)").alias("ref"), F.lit("A").alias("alt"))


def unique_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.drop_duplicates(_calls(spark, sf_dir)).select("chrom", "pos", "ref", "alt", "id")


def combined_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.combine_alleles(_calls(spark, sf_dir)).select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"))


def separate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.remove_overlaps(vcf.drop_duplicates(_calls(spark, sf_dir))).select("chrom", "pos", "ref", "alt")


def calls_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vcf.filter_regions(_calls(spark, sf_dir), _features(spark, sf_dir)).select("chrom", "pos", "id")


def call_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callset.overlapping_features(_calls(spark, sf_dir), _features(spark, sf_dir))


def call_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callset.nearest_feature(_calls(spark, sf_dir), _features(spark, sf_dir))


def call_flanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = callset.reference_windows(_chroms(spark, sf_dir), 256, 64)
    return callset.add_flanks(_item_calls(spark, sf_dir), windows, _FLANK, 256).select("id", "left_flank", "right_flank")


def call_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = callset.reference_windows(_chroms(spark, sf_dir), 256, 64)
    turned = _item_calls(spark, sf_dir).withColumn("ref", F.when(F.col("pos") % 2 == 0, reverse_complement(F.col("ref"))).otherwise(F.col("ref")))
    return callset.correct_strand(turned, windows, 256).select("id", "ref", "alt", "strand")


def sv_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callset.sv_lengths(_calls(spark, sf_dir))


def call_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callset.chromosome_bins(_calls(spark, sf_dir), 1000)


def call_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callset.info_tags(_calls(spark, sf_dir))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callset.transitions_by(_calls(spark, sf_dir), "chrom")


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fastn.base_counts(reads_of_prose(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang"), "read_id").withColumnRenamed("name", "doc_id")


def split_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads_of_prose(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang").withColumn("seq", F.coalesce("seq", F.lit("")))
    return fastn.split_entries(rows, 200, 30, "read_id").groupBy(F.col("name").alias("doc_id")).agg(F.count("*").alias("parts"), F.sum(F.length("seq")).alias("bases"))


def duplicate_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads left of neighbouring documents as pairs."""
    found = _docs(spark, sf_dir).withColumns({"mate": F.expr("cast(read_id % 2 AS int)"), "read_id": F.expr("read_id div 2")})
    return filters.drop_duplicate_pairs(found, K).select("sample", "read_id").distinct()


def _changed(chroms: DataFrame, sample: str, change: str) -> DataFrame:
    """Contigs of chromosomes with bases in their middle put in place of the two that are there."""
    seq = F.expr(f"concat(left(seq, length(seq) div 2), {change}, substring(seq, length(seq) div 2 + 3))")
    reads = chroms.select(F.lit(sample).alias("sample"), F.xxhash64("chrom").alias("read_id"), F.lit(0).alias("mate"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))
    return filters.contigs(reads, K_PATHS)


def _two_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items, and the same items with two bases complemented."""
    chroms = _chroms(spark, sf_dir)
    own, other = "substring(seq, length(seq) div 2 + 1, 2)", "translate(substring(seq, length(seq) div 2 + 1, 2), 'ACGT', 'TGCA')"
    return graph.build(_changed(chroms, "items", own).unionByName(_changed(chroms, "changed", other)), K_PATHS)


def colour_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bubbles between the benchmark items and the same items with two bases complemented."""
    return discovery.call_bubbles(unitigs.written(_two_colours(spark, sf_dir)), K_PATHS, ["items"], ["changed"]).select("flank5p", "branch1", "branch2", "flank3p")


def path_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through changed items that leave the items and return."""
    chroms = _chroms(spark, sf_dir)
    sample = unitigs.written(graph.union_of_colours(graph.build(_changed(chroms, "s", "'ACA'"), K_PATHS)))
    return discovery.path_divergences(chroms, sample, K_PATHS, 200).select("chrom", "pos", "branch1", "branch2")


def corrected_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a poor base changed in the middle, corrected by the items' own graph."""
    reads = _chroms(spark, sf_dir).select(F.col("chrom").cast("long").alias("read_id"), F.col("chrom").alias("name"), F.expr("concat(left(seq, length(seq) div 2), 'A', substring(seq, length(seq) div 2 + 2))").alias("seq"))
    reads = reads.withColumn("qual", F.expr("concat(repeat('I', length(seq) div 2), '#', repeat('I', length(seq) - length(seq) div 2 - 1))"))
    return correction.correct(reads.where("length(seq) > 0"), _item_graph(spark, sf_dir), K_PATHS, 10).select("id", "decision", "n_fixed", "seq")


def site_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a site, its lines as samples."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("a"), (F.col("l_suppkey") % 30).cast("int").alias("b")).alias("x"))
    sites = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select("l_orderkey", F.col("x.a").alias("c1"), F.col("x.b").alias("c2"), F.lit(20.0).alias("mean"))
    return population.classify(sites).select("l_orderkey", "model", F.round("llk_error", 4).alias("llk_error"), F.round("llk_repeat", 4).alias("llk_repeat"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        covg_distribution, kmer_counts, read_lengths, sample_metadata, homopolymer_contigs, degree_distribution, sharing, colour_overlaps, pan_genome_matrix, health_check,
        low_coverage_kmers, supernodes, supernode_n50, clipped_tips, cleaned_supernodes, bubbles, genotypes, call_summary,
        wide_kmers, item_bubbles, supernode_junctions, supernode_errors, kmer_places, item_coverages, items_in_graph, item_paths, regenotyped_calls,
        unique_calls, combined_alleles, separate_calls, calls_in_regions, call_features, call_distances, call_flanks, call_strands, sv_lengths, call_bins, call_tags, transitions,
        base_counts, split_sequences, duplicate_starts, colour_bubbles, path_divergences, corrected_reads, site_models,
    )
}


def _contigs_sql(table: str, sample: str, id_col: str, k: int, name: str = "c") -> str:
    """Contigs of at least k bases, as text_to_dna and contigs make them."""
    dna = f"translate(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'), '{_ALPHABET}{_ALPHABET.lower()}0123456789', '{('ACGT' * 7)[:26] * 2}NNNNNNNNNN')"
    return f"{name} AS (SELECT * FROM (SELECT {sample} AS sample, {id_col} AS read_id, unnest(string_split_regex({dna}, 'N+')) AS seq FROM {table}) WHERE length(seq) >= {k})"


def _rc(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def _nodes_sql(table: str, sample: str, id_col: str, k: int) -> str:
    """n (kmer, colour, covg, edges) by strings."""
    bit = lambda s: f"(1 << (strpos('ACGT', {s}) - 1))"
    comp = "translate({}, 'ACGT', 'TGCA')"
    return f"""{_contigs_sql(table, sample, id_col, k)},
p AS (SELECT sample, seq, unnest(generate_series(1, length(seq) - {k} + 1)) AS i FROM c),
w AS (SELECT sample, substr(seq, i, {k}) AS s, substr(seq, i + {k}, 1) AS nx, CASE WHEN i > 1 THEN substr(seq, i - 1, 1) ELSE '' END AS pv FROM p),
o AS (SELECT sample, least(s, {_rc("s")}) AS kmer, s < {_rc("s")} AS fw, CASE WHEN nx <> '' THEN {bit("nx")} ELSE 0 END AS a, CASE WHEN pv <> '' THEN {bit(comp.format("pv"))} ELSE 0 END AS b FROM w),
n AS (SELECT kmer, sample AS colour, count(*) AS covg, CAST(bit_or(CASE WHEN fw THEN a + b * 16 ELSE a * 16 + b END) AS INTEGER) AS edges FROM o GROUP BY kmer, sample)"""


def _edges_sql(graph_: str, k: int, p: str) -> str:
    """{p}d (s, covg, x, o, i): oriented nodes of a graph (kmer, covg, edges) with their exits as bits, and numbers of exits and entries; {p}e (s, b, t): their edges."""
    return f"""{p}d AS (SELECT s, covg, x, bit_count(x) AS o, bit_count(y) AS i FROM (SELECT kmer AS s, covg, edges & 15 AS x, edges >> 4 AS y FROM {graph_} UNION ALL SELECT {_rc("kmer")}, covg, edges >> 4, edges & 15 FROM {graph_})),
{p}e AS (SELECT s, o, i, b, substr(s, 2) || b AS t FROM (SELECT s, o, i, x, unnest(['A', 'C', 'G', 'T']) AS b FROM {p}d) WHERE (x >> (strpos('ACGT', b) - 1)) & 1 = 1)"""


def _paths_sql(graph_: str, k: int, p: str) -> str:
    """{p}u (seq, start, node, n, lo, hi, total, ie, oe, de): all paths from either end, walked step by step; loops without an end are not there."""
    return f"""{_edges_sql(graph_, k, p)},
{p}w AS (
  SELECT s || b AS seq, s AS start, t AS node, 1 AS n, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi, i AS ie FROM {p}e WHERE NOT (i = 1 AND o = 1)
  UNION ALL
  SELECT w.seq || e.b, w.start, e.t, w.n + 1, least(w.lo, d.covg), greatest(w.hi, d.covg), w.ie FROM {p}w w JOIN {p}d d ON d.s = w.node AND d.i = 1 AND d.o = 1 JOIN {p}e e ON e.s = w.node),
{p}u AS (SELECT w.*, d.i AS de, d.o AS oe FROM {p}w w JOIN {p}d d ON d.s = w.node WHERE NOT (d.i = 1 AND d.o = 1))"""


def _cleaned_sql(graph_: str, gone: str, k: int, p: str) -> str:
    """{p}g (kmer, covg, edges): a graph without some k-mers and without edges to k-mers that are not there."""
    return f"""{p}k AS (SELECT * FROM {graph_} WHERE kmer NOT IN (SELECT kmer FROM {gone})),
{p}b AS (SELECT kmer, covg, edges, unnest(generate_series(0, 7)) AS bit FROM {p}k),
{p}t AS (SELECT *, substr(CASE WHEN bit < 4 THEN kmer ELSE {_rc("kmer")} END, 2) || substr('ACGT', bit % 4 + 1, 1) AS t FROM {p}b),
{p}g AS (SELECT kmer, covg, CAST(coalesce(bit_or(CASE WHEN (edges >> bit) & 1 = 1 AND h.kmer2 IS NOT NULL THEN 1 << bit ELSE 0 END), 0) AS INTEGER) AS edges
  FROM {p}t LEFT JOIN (SELECT kmer AS kmer2 FROM {p}k) h ON h.kmer2 = least(t, {_rc("t")}) GROUP BY kmer, covg)"""


_N = _nodes_sql("documents", "lang", "doc_id", K)
_I = _nodes_sql("benchmark", "'all'", "item_id", K_PATHS)
_LF = "CASE WHEN {0} < 2 THEN 0.0 ELSE list_sum(list_transform(generate_series(1, {0}), lambda x: ln(CAST(x AS DOUBLE)))) END"

ORACLES: dict[str, str] = {
    "covg_distribution": f"WITH {_N} SELECT colour, least(covg, 10000) AS covg, count(*) AS n FROM n GROUP BY 1, 2",
    "kmer_counts": f"WITH {_I} SELECT kmer, covg, edges FROM n",
    "read_lengths": f"WITH {_contigs_sql('documents', 'lang', 'doc_id', K)} SELECT sample, CAST(length(seq) AS INTEGER) AS length, count(*) AS n FROM c GROUP BY 1, 2",
    "sample_metadata": f"WITH {_contigs_sql('documents', 'source', 'doc_id', K)} SELECT sample, CAST(sum(length(seq)) AS BIGINT) AS total_seq, CAST(sum(length(seq)) // count(*) AS BIGINT) AS mean_read_len FROM c GROUP BY 1",
    "degree_distribution": f"WITH {_N} SELECT colour, CAST(bit_count(edges & 15) AS INTEGER) AS out_fw, CAST(bit_count(edges >> 4) AS INTEGER) AS out_rc, count(*) AS n FROM n GROUP BY 1, 2, 3",
    "sharing": f"WITH {_N} SELECT n_colours, count(*) AS n FROM (SELECT kmer, count(*) AS n_colours FROM n WHERE edges <> 0 GROUP BY kmer) GROUP BY 1",
    "colour_overlaps": f"WITH {_N} SELECT x.colour AS a, y.colour AS b, count(*) AS n FROM n x JOIN n y USING (kmer) WHERE x.edges <> 0 AND y.edges <> 0 GROUP BY 1, 2",
    "pan_genome_matrix": f"""WITH {_N}, {_contigs_sql("benchmark", "'all'", "item_id", K, "g")},
q AS (SELECT read_id AS item_id, substr(seq, i, {K}) AS s FROM (SELECT read_id, seq, unnest(generate_series(1, length(seq) - {K} + 1)) AS i FROM g)),
q2 AS (SELECT item_id, least(s, {_rc("s")}) AS kmer FROM q), z AS (SELECT item_id, count(*) AS size FROM q2 GROUP BY 1)
SELECT z.item_id, c.colour, round(count(n.kmer) / any_value(size), 2) AS fraction, min(covg) AS least
FROM z CROSS JOIN (SELECT DISTINCT colour FROM n) c JOIN q2 ON q2.item_id = z.item_id LEFT JOIN n ON n.kmer = q2.kmer AND n.colour = c.colour GROUP BY 1, 2""",
    "low_coverage_kmers": f"""WITH {_N}, k AS (SELECT kmer FROM n GROUP BY kmer HAVING sum(covg) > 2),
b AS (SELECT kmer, colour, edges, unnest(generate_series(0, 7)) AS bit FROM n WHERE kmer IN (SELECT kmer FROM k)),
t AS (SELECT *, substr(CASE WHEN bit < 4 THEN kmer ELSE {_rc("kmer")} END, 2) || substr('ACGT', bit % 4 + 1, 1) AS t FROM b WHERE (edges >> bit) & 1 = 1),
g AS (SELECT kmer, colour, bit_or(1 << bit) AS edges FROM t WHERE least(t, {_rc("t")}) IN (SELECT kmer FROM k) GROUP BY 1, 2),
cl AS (SELECT n.colour, coalesce(g.edges, 0) AS edges FROM n JOIN k USING (kmer) LEFT JOIN g ON g.kmer = n.kmer AND g.colour = n.colour)
SELECT colour, CAST(bit_count(edges & 15) AS INTEGER) AS out_fw, CAST(bit_count(edges >> 4) AS INTEGER) AS out_rc, count(*) AS n FROM cl GROUP BY 1, 2, 3""",
    "genotypes": f"""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS c1, l_suppkey % 30 AS c2 FROM lineitem),
l AS (SELECT *, round(c1 * ln(20.0) - 20.0 - {_LF.format("c1")} + greatest(0.0, c2 - 0.2) * ln(0.01), 6) AS h1,
  round((c1 * ln(10.0) - 10.0 - {_LF.format("c1")}) + (c2 * ln(10.0) - 10.0 - {_LF.format("c2")}), 6) AS h, round(c2 * ln(20.0) - 20.0 - {_LF.format("c2")} + greatest(0.0, c1 - 0.2) * ln(0.01), 6) AS h2 FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN c1 + c2 <= 0 THEN 'NO_CALL' WHEN h1 >= h AND h1 >= h2 THEN 'HOM1' WHEN h >= h2 THEN 'HET' ELSE 'HOM2' END AS gt,
  round(list_sort([h1, h, h2])[3] - list_sort([h1, h, h2])[2], 2) AS gt_conf FROM l""",
}

_CALL_SQL = f"calls AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _CALLS.items())} FROM lineitem)"
_FEATURE_SQL = f"features AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _FEATURES.items())} FROM part)"
_DNA = f"translate(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'), '{_ALPHABET}{_ALPHABET.lower()}0123456789', '{('ACGT' * 7)[:26] * 2}NNNNNNNNNN')"
_UNIQUE_SQL = "u AS (SELECT chrom, pos, ref, alt, min(id) AS id FROM calls GROUP BY ALL)"
_ITEM_SQL = f"""chroms AS (SELECT CAST(item_id AS VARCHAR) AS chrom, {_DNA} AS seq FROM benchmark),
i AS (SELECT *, substr(seq, p, 1 + p % 3) AS ref, concat(chrom, '_', p) AS id FROM (SELECT chrom, seq, unnest(generate_series(1, length(seq), {_STEP})) AS p FROM chroms WHERE length(seq) > 0))"""

ORACLES |= {
    "unique_calls": f"WITH {_CALL_SQL}, {_UNIQUE_SQL} SELECT * FROM u",
    "combined_alleles": f"WITH {_CALL_SQL} SELECT chrom, pos, ref, string_agg(DISTINCT alt, ',' ORDER BY alt) AS alts FROM calls GROUP BY 1, 2, 3",
    "separate_calls": f"""WITH {_CALL_SQL}, {_UNIQUE_SQL}, n AS (SELECT *, row_number() OVER () AS k FROM u)
SELECT chrom, pos, ref, alt FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.chrom = b.chrom AND a.k <> b.k AND a.pos <= b.pos + length(b.ref) - 1 AND b.pos <= a.pos + length(a.ref) - 1 AND b.pos BETWEEN a.pos - 3 AND a.pos + 3)""",
    "calls_in_regions": f"WITH {_CALL_SQL}, {_FEATURE_SQL} SELECT chrom, pos, id FROM calls c WHERE EXISTS (SELECT 1 FROM features f WHERE f.chrom = c.chrom AND c.pos BETWEEN f.start AND f.stop)",
    "call_features": f"""WITH {_CALL_SQL}, {_FEATURE_SQL} SELECT c.chrom, pos, ref, alt, string_agg(DISTINCT name, ',' ORDER BY name) AS features
FROM calls c JOIN features f ON f.chrom = c.chrom AND c.pos <= f.stop AND c.pos + length(c.ref) - 1 >= f.start GROUP BY 1, 2, 3, 4""",
    "call_distances": f"""WITH {_CALL_SQL}, {_FEATURE_SQL}, p AS (SELECT DISTINCT chrom, pos FROM calls),
d AS (SELECT p.chrom, p.pos, min(greatest(f.start - p.pos, p.pos - f.stop, 0)) AS distance FROM p JOIN features f ON f.chrom = p.chrom GROUP BY 1, 2)
SELECT chrom, pos, ref, alt, distance FROM calls LEFT JOIN d USING (chrom, pos)""",
    "call_flanks": f"WITH {_ITEM_SQL} SELECT id, substr(seq, CAST(greatest(p - {_FLANK}, 1) AS BIGINT), CAST(least({_FLANK}, p - 1) AS BIGINT)) AS left_flank, substr(seq, p + length(ref), {_FLANK}) AS right_flank FROM i",
    "call_strands": f"""WITH {_ITEM_SQL}, t AS (SELECT id, ref AS own, CASE WHEN p % 2 = 0 THEN {_rc("ref")} ELSE ref END AS ref FROM i)
SELECT id, own AS ref, CASE WHEN own = ref THEN 'A' ELSE 'T' END AS alt, CASE WHEN own = ref THEN 1 ELSE -1 END AS strand FROM t""",
    "sv_lengths": f"WITH {_CALL_SQL} SELECT CAST(length(alt) - length(ref) AS INTEGER) AS svlen, count(*) AS n FROM calls GROUP BY 1",
    "call_bins": f"WITH {_CALL_SQL} SELECT chrom, (pos - 1) // 1000 AS bin, count(*) AS n FROM calls GROUP BY 1, 2",
    "call_tags": f"WITH {_CALL_SQL} SELECT 'K' AS tag, CAST(length(ref) AS VARCHAR) AS value, count(*) AS n FROM calls GROUP BY 2",
    "transitions": f"""WITH {_CALL_SQL} SELECT chrom, count(*) FILTER (ref || alt IN ('AG', 'GA', 'CT', 'TC')) AS transitions, count(*) FILTER (ref || alt NOT IN ('AG', 'GA', 'CT', 'TC')) AS transversions
FROM calls WHERE length(ref) = 1 AND length(alt) = 1 AND ref <> alt GROUP BY 1""",
    "base_counts": f"""WITH s AS (SELECT doc_id, {_DNA} AS seq FROM documents), b AS (SELECT doc_id, {', '.join(f"length(seq) - length(replace(seq, '{x}', '')) AS {x.lower()}" for x in "ACGT")}, length(seq) - length(replace(seq, 'N', '')) AS other FROM s)
SELECT *, round((g + c) / nullif(a + c + g + t, 0), 4) AS gc FROM b""",
    "split_sequences": f"""WITH s AS (SELECT doc_id, coalesce(length({_DNA}), 0) AS n FROM documents), p AS (SELECT doc_id, n, unnest(generate_series(1, greatest(n - 30, 1), 170)) AS b FROM s)
SELECT doc_id, count(*) AS parts, CAST(sum(greatest(0, least(200, n - b + 1))) AS BIGINT) AS bases FROM p GROUP BY 1""",
    "duplicate_starts": f"""WITH {_contigs_sql("documents", "lang", "doc_id", K)}, o AS (SELECT lang AS sample, doc_id // 2 AS read_id, doc_id % 2 AS mate, regexp_extract({_DNA}, '[ACGT]{{{K},}}') AS seq FROM documents),
s AS (SELECT sample, read_id, mate, substr(seq, 1, {K}) AS start FROM o WHERE length(seq) >= {K}), f AS (SELECT sample, start, min(read_id) AS first FROM s GROUP BY 1, 2)
SELECT DISTINCT sample, read_id FROM s JOIN f USING (sample, start) WHERE first = read_id""",
}

_ITEMS = f"WITH RECURSIVE {_I}"
_P = _paths_sql("n", K_PATHS, "p")
_ONCE = f"sn AS (SELECT DISTINCT * FROM pu WHERE seq <= {_rc('seq')})"
_TIPS = f"tips AS (SELECT DISTINCT least(x, {_rc('x')}) AS kmer FROM (SELECT substr(seq, unnest(generate_series(1, n)), {K_PATHS}) AS x FROM pu WHERE ie = 0 AND de > 1 AND n <= {K_PATHS} + 1))"
_MIDDLE = "substr(seq, CAST(length(seq) // 2 + 1 AS BIGINT), 2)"
_TWO = f"""chroms AS (SELECT CAST(item_id AS VARCHAR) AS chrom, {_DNA} AS seq FROM benchmark),
reads AS (SELECT 'items' AS sample, chrom, seq FROM chroms UNION ALL
  SELECT 'changed', chrom, left(seq, length(seq) // 2) || translate({_MIDDLE}, 'ACGT', 'TGCA') || substr(seq, CAST(length(seq) // 2 + 3 AS BIGINT)) FROM chroms),
c AS (SELECT * FROM (SELECT sample, chrom AS read_id, unnest(string_split_regex(seq, 'N+')) AS seq FROM reads) WHERE length(seq) >= {K_PATHS}),
{_nodes_sql("benchmark", "'all'", "item_id", K_PATHS).split(chr(10), 1)[1]}"""
_KMERS_OF_ITEMS = f"""chroms AS (SELECT CAST(item_id AS VARCHAR) AS id, {_DNA} AS seq FROM benchmark),
places AS (SELECT id, seq, pos, substr(seq, pos + 1, {K}) AS s, substr(seq, pos + 1, {K} + 1) AS step FROM (SELECT id, seq, unnest(generate_series(0, length(seq) - {K})) AS pos FROM chroms WHERE length(seq) >= {K})),
found AS (SELECT id, seq, pos, step, least(s, {_rc("s")}) AS kmer FROM places WHERE s NOT LIKE '%N%')"""
_STEPS_EN = f"""steps AS (SELECT DISTINCT least(x, {_rc("x")}) AS x FROM (SELECT substr(seq, unnest(generate_series(1, length(seq) - {K})), {K} + 1) AS x FROM c WHERE sample = 'en' AND length(seq) > {K})),
marked AS (SELECT f.id, f.seq, f.pos, least(step, {_rc("step")}) IN (SELECT x FROM steps) AND length(step) = {K} + 1 AS edge FROM found f WHERE f.kmer IN (SELECT kmer FROM n WHERE colour = 'en')),
parts AS (SELECT *, sum(CASE WHEN coalesce(before = pos - 1 AND was, false) THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS part FROM (SELECT *, lag(pos) OVER (PARTITION BY id ORDER BY pos) AS before, lag(edge) OVER (PARTITION BY id ORDER BY pos) AS was FROM marked)),
spans AS (SELECT id, min(pos) AS start, substr(any_value(seq), CAST(min(pos) + 1 AS BIGINT), CAST(max(pos) - min(pos) + {K} AS BIGINT)) AS seq FROM parts GROUP BY id, part)"""
_SVTYPE = f"""CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN length(ref) = length(alt) AND ref = {_rc("alt")} THEN 'INV' WHEN length(ref) = length(alt) THEN 'PH_SNPS' WHEN length(ref) = 0 THEN 'INS' WHEN length(alt) = 0 THEN 'DEL'
WHEN length(ref) = 1 AND left(alt, 1) = ref THEN 'INS' WHEN length(alt) = 1 AND left(ref, 1) = alt THEN 'DEL' WHEN length(ref) < length(alt) AND (starts_with(alt, ref) OR ends_with(alt, ref)) THEN 'INDEL'
WHEN length(alt) < length(ref) AND (starts_with(ref, alt) OR ends_with(ref, alt)) THEN 'INDEL' ELSE 'COMPLEX' END"""
_HOMOPOLYMERS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, 'A{{4,}}', 'AAAN', 'g'), 'C{{4,}}', 'CCCN', 'g'), 'G{{4,}}', 'GGGN', 'g'), 'T{{4,}}', 'TTTN', 'g')".format(_DNA)
_READS = "CAST(CASE WHEN len({0}) < 1 THEN 0 ELSE {0}[1] + coalesce(list_sum(list_transform(generate_series(2, len({0})), lambda j: greatest(0, {0}[j] - {0}[j - 1]))), 0) END AS BIGINT)"
_MEDIAN = "CASE WHEN len({0}) < 1 THEN 0 ELSE (list_sort({0})[(len({0}) + 1) // 2] + list_sort({0})[len({0}) // 2 + 1]) // 2 END"

_LBETA = "(lgamma({0}) + lgamma({1}) - lgamma(({0}) + ({1})))"
_SITES = f"""WITH s AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber) AS a, list(CAST(l_suppkey % 30 AS INTEGER) ORDER BY l_linenumber) AS b FROM lineitem GROUP BY 1),
t AS (SELECT *, CAST(list_sum(a) AS DOUBLE) AS s1, CAST(list_sum(b) AS DOUBLE) AS s2, len(a) AS n FROM s),
c AS (SELECT *, s1 + s2 AS total, list_transform(generate_series(1, 10), lambda g: (s1 + s2) * ln(g) + 40.0 * g * ln(40.0 * g) - lgamma(40.0 * g) + lgamma(40.0 * g + s1 + s2) - (40.0 * g + s1 + s2) * ln(40.0 * g + 40.0 * g * n)) AS cov,
  list_transform(generate_series(1, n), lambda j: [a[j] * ln(0.99) + b[j] * ln(0.01), (a[j] + b[j]) * ln(0.5), a[j] * ln(0.01) + b[j] * ln(0.99)]) AS per,
  list_transform(generate_series(1, 2 * n - 1), lambda j: j / (2.0 * n)) AS f FROM t),
g AS (SELECT *, cov[1] - list_max(cov) AS one, list_transform(f, lambda v: list_sum(list_transform(per, lambda x: ln((1 - v) * (1 - v) * exp(x[1] - list_max(x)) + 2 * v * (1 - v) * exp(x[2] - list_max(x)) + v * v * exp(x[3] - list_max(x))) + list_max(x)))) AS lf FROM c),
h AS (SELECT *, list_max(lf) AS top FROM g),
m AS (SELECT *, one + top + ln(list_sum(list_transform(generate_series(1, len(f)), lambda j: exp(lf[j] - top) / (f[j] * (1 - f[j])))) / list_sum(list_transform(f, lambda v: 1 / (v * (1 - v))))) AS var,
  one + {_LBETA.format("1.0 + least(s1, s2)", "100.0 + greatest(s1, s2)")} - {_LBETA.format("1.0", "100.0")} AS err, {_LBETA.format("2.0 + s1", "2.0 + s2")} - {_LBETA.format("2.0", "2.0")} AS rep FROM h)
SELECT l_orderkey, CASE WHEN total <= 0 THEN NULL WHEN var >= err AND var >= rep THEN 'variant' WHEN err >= rep THEN 'error' ELSE 'repeat' END AS model, round(err, 4) AS llk_error, round(rep, 4) AS llk_repeat FROM m"""

ORACLES |= {
    "site_models": _SITES,
    "wide_kmers": f"WITH {_nodes_sql('benchmark', chr(39) + 'all' + chr(39), 'item_id', K_WIDE)} SELECT kmer, covg, edges FROM n",
    "homopolymer_contigs": f"""WITH c AS (SELECT * FROM (SELECT lang AS sample, unnest(string_split_regex({_HOMOPOLYMERS}, 'N+')) AS seq FROM documents) WHERE length(seq) >= {K})
SELECT sample, CAST(length(seq) AS INTEGER) AS length, count(*) AS n FROM c GROUP BY 1, 2""",
    "health_check": f"""{_ITEMS}, h AS (SELECT kmer, covg, edges FROM n WHERE covg > 1), {_edges_sql("h", K_PATHS, "p")}
SELECT 'missing node' AS problem, count(*) AS n FROM pe WHERE least(t, {_rc("t")}) NOT IN (SELECT kmer FROM h) HAVING count(*) > 0""",
    "supernodes": f"{_ITEMS}, {_P}, {_ONCE} SELECT DISTINCT seq, CAST(n AS INTEGER) AS n_edges, lo AS min_covg, hi AS max_covg, start = node AS is_cycle FROM sn",
    "supernode_n50": f"""{_ITEMS}, {_P}, {_ONCE}, l AS (SELECT length(seq) AS length, count(*) AS n FROM (SELECT DISTINCT seq FROM sn) GROUP BY 1),
r AS (SELECT length, sum(length * n) OVER (ORDER BY length DESC) AS run, (SELECT sum(length * n) FROM l) AS total FROM l)
SELECT CAST(max(length) AS BIGINT) AS n50, (SELECT CAST(sum(n) AS BIGINT) FROM l) AS supernodes FROM r WHERE 2 * run >= total""",
    "supernode_junctions": f"{_ITEMS}, {_P}, {_ONCE} SELECT CAST(ie AS INTEGER) AS entries, CAST(oe AS INTEGER) AS exits, count(*) AS n FROM (SELECT DISTINCT seq, ie, oe FROM sn) GROUP BY 1, 2",
    "supernode_errors": f"{_ITEMS}, {_P}, {_ONCE} SELECT count(*) FILTER (hi <= 1) AS errors, count(*) FILTER (hi > 1) AS others FROM (SELECT DISTINCT seq, hi FROM sn)",
    "clipped_tips": f"{_ITEMS}, {_P}, {_TIPS}, {_cleaned_sql('n', 'tips', K_PATHS, 'c')} SELECT kmer, covg, edges FROM cg",
    "cleaned_supernodes": f"""{_ITEMS}, {_P}, {_TIPS}, {_cleaned_sql("n", "tips", K_PATHS, "c")}, {_paths_sql("cg", K_PATHS, "q")},
poor AS (SELECT DISTINCT least(x, {_rc("x")}) AS kmer FROM (SELECT substr(seq, unnest(generate_series(2, n)), {K_PATHS}) AS x FROM qu WHERE hi <= 1 AND n > 1)),
{_cleaned_sql("cg", "poor", K_PATHS, "f")} SELECT kmer, covg, edges FROM fg""",
    "item_bubbles": f"""WITH RECURSIVE {_TWO}, u AS (SELECT kmer, sum(covg) AS covg, bit_or(edges) AS edges FROM n GROUP BY kmer), {_paths_sql("u", K_PATHS, "p")},
l AS (SELECT start, node, list_sort(list(DISTINCT substr(seq, {K_PATHS + 1}))) AS b FROM pu GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY b[1], b[2]) AS r FROM l WHERE len(b) > 1)
SELECT b[1] AS branch1, b[2] AS branch2 FROM f WHERE r = 1 AND least(start, {_rc("start")}) <= least(node, {_rc("node")})""",
    "colour_bubbles": f"""WITH RECURSIVE {_TWO}, u AS (SELECT kmer, sum(covg) AS covg, bit_or(edges) AS edges FROM n GROUP BY kmer), {_paths_sql("u", K_PATHS, "p")},
l AS (SELECT start, node, list_sort(list(DISTINCT substr(seq, {K_PATHS + 1}))) AS b FROM pu GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY b[1], b[2]) AS r FROM l WHERE len(b) > 1),
bb AS (SELECT start, node, b[1] AS b1, b[2] AS b2 FROM f WHERE r = 1 AND least(start, {_rc("start")}) <= least(node, {_rc("node")})),
iv AS (SELECT start, node, which, m, least(x, {_rc("x")}) AS kmer FROM (SELECT start, node, which, length(br) - 1 AS m, substr(start || br, unnest(generate_series(1, length(br) - 1)) + 1, {K_PATHS}) AS x
  FROM (SELECT start, node, 1 AS which, b1 AS br FROM bb UNION ALL SELECT start, node, 2, b2 FROM bb))),
se AS (SELECT start, node, which, any_value(m) AS m, count(i.kmer) AS s, count(j.kmer) AS t FROM iv LEFT JOIN n i ON i.kmer = iv.kmer AND i.colour = 'items' LEFT JOIN n j ON j.kmer = iv.kmer AND j.colour = 'changed' GROUP BY 1, 2, 3),
ok AS (SELECT x.start, x.node FROM se x JOIN se y ON x.start = y.start AND x.node = y.node AND x.which = 1 AND y.which = 2
  WHERE (x.s = x.m AND x.t <= 1 AND y.t = y.m AND y.s <= 1) OR (x.t = x.m AND x.s <= 1 AND y.s = y.m AND y.t <= 1)),
wi AS (SELECT node AS start, right(seq, {K_PATHS} + 1000) AS f5 FROM pu WHERE de = 1), wo AS (SELECT start AS node, substr(min(seq), {K_PATHS + 1}, 1000) AS f3 FROM pu GROUP BY 1 HAVING count(*) = 1)
SELECT coalesce(f5, bb.start) AS flank5p, b1 AS branch1, b2 AS branch2, coalesce(f3, '') AS flank3p FROM bb JOIN ok USING (start, node) LEFT JOIN wi USING (start) LEFT JOIN wo USING (node)""",
    "kmer_places": f"WITH {_KMERS_OF_ITEMS} SELECT id, pos, times FROM found JOIN (SELECT kmer, count(*) AS times FROM found GROUP BY 1) USING (kmer)",
    "item_coverages": f"""WITH {_N}, {_KMERS_OF_ITEMS}, wide AS (SELECT kmer, {', '.join(f"CAST(coalesce(sum(covg) FILTER (colour = '{c}'), 0) AS BIGINT) AS {c}" for c in ("en", "de", "fr", "es"))} FROM n GROUP BY kmer)
SELECT id, pos, {', '.join(f"coalesce({c}, 0) AS {c}" for c in ("en", "de", "fr", "es"))} FROM found LEFT JOIN wide USING (kmer)""",
    "items_in_graph": f"WITH {_N}, {_KMERS_OF_ITEMS}, {_STEPS_EN} SELECT id, start, seq FROM spans",
    "item_paths": f"WITH {_N}, {_KMERS_OF_ITEMS}, {_STEPS_EN} SELECT id, coalesce(id IN (SELECT s.id FROM spans s JOIN chroms h USING (id) WHERE s.seq = h.seq), false) AS present FROM chroms",
    "regenotyped_calls": f"""WITH {_TWO},
v AS (SELECT chrom AS var_id, left(seq, length(seq) // 2) AS f5, {_MIDDLE} AS b1, translate({_MIDDLE}, 'ACGT', 'TGCA') AS b2, substr(seq, CAST(length(seq) // 2 + 3 AS BIGINT)) AS f3 FROM chroms),
al AS (SELECT var_id, which, right(f5, {K_PATHS}) || CASE WHEN which = 1 THEN b1 ELSE b2 END || left(f3, {K_PATHS}) AS seq FROM v, (SELECT unnest([1, 2]) AS which)),
km AS (SELECT var_id, which, pos, least(x, {_rc("x")}) AS kmer FROM (SELECT var_id, which, pos, substr(seq, pos + 1, {K_PATHS}) AS x FROM (SELECT *, unnest(generate_series(1, length(seq) - {K_PATHS})) AS pos FROM al WHERE length(seq) > {K_PATHS})) WHERE x NOT LIKE '%N%'),
cv AS (SELECT var_id, which, s.colour, list(coalesce(n.covg, 0) ORDER BY pos) AS cs FROM km CROSS JOIN (SELECT unnest(['items', 'changed']) AS colour) s LEFT JOIN n ON n.kmer = km.kmer AND n.colour = s.colour GROUP BY 1, 2, 3),
two AS (SELECT var_id, colour, coalesce(any_value(cs) FILTER (which = 1), []) AS x, coalesce(any_value(cs) FILTER (which = 2), []) AS y FROM cv GROUP BY 1, 2),
r AS (SELECT var_id, colour, {_READS.format("x")} AS c1, {_READS.format("y")} AS c2, {_MEDIAN.format("x")} AS median1, {_MEDIAN.format("y")} AS median2, coalesce(list_min(x), 0) AS min1, coalesce(list_min(y), 0) AS min2, (200 - {K_PATHS} + 1) / 200.0 AS th FROM two),
l AS (SELECT *, round(c1 * ln(th) - th - {_LF.format("c1")} + greatest(0.0, c2 - 0.01 * th) * ln(0.01), 6) AS h1,
  round((c1 * ln(th / 2) - th / 2 - {_LF.format("c1")}) + (c2 * ln(th / 2) - th / 2 - {_LF.format("c2")}), 6) AS h, round(c2 * ln(th) - th - {_LF.format("c2")} + greatest(0.0, c1 - 0.01 * th) * ln(0.01), 6) AS h2 FROM r)
SELECT var_id, colour, CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, CAST(median1 AS BIGINT) AS median1, CAST(median2 AS BIGINT) AS median2, CAST(min1 AS BIGINT) AS min1, CAST(min2 AS BIGINT) AS min2,
  CASE WHEN c1 + c2 <= 0 THEN 'NO_CALL' WHEN h1 >= h AND h1 >= h2 THEN 'HOM1' WHEN h >= h2 THEN 'HET' ELSE 'HOM2' END AS gt, round(list_sort([h1, h, h2])[3] - list_sort([h1, h, h2])[2], 2) AS gt_conf FROM l""",
    "call_summary": f"""WITH s AS (SELECT p_partkey, translate(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'), '{_ALPHABET}{_ALPHABET.lower()}0123456789', '{('ACGT' * 7)[:26] * 2}NNNNNNNNNN') AS dna FROM part),
a AS (SELECT substr(dna, 1, 1) AS ref, substr(dna, 2, CAST(p_partkey % 3 + 1 AS BIGINT)) AS alt FROM s)
SELECT {_SVTYPE} AS svtype, CAST(length(alt) - length(ref) AS INTEGER) AS svlen, count(*) AS n FROM a GROUP BY 1, 2""",
}
