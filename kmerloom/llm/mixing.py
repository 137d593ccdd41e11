"""Mixing sources to target weights by Pfair scheduling.

Documents of a source come in blocks.  With integer weights s of sum q, block j
(from 0) of a source is released at slot floor(j q / s) and due before slot
ceil((j + 1) q / s).  One block goes into each slot: of those released, the one
due first.  One block a slot at full load is what earliest deadline first can
always do in time, so after any number of slots every source is less than one
block away from its share.

The schedule repeats after q slots.  One such cycle is worked out, whatever the
number of documents; block j then goes to slot q (j div s) + the cycle's slot for
block j mod s.  No task goes through the mix in order.  A source that has run out
leaves its slots empty, and the others keep their proportions: nothing is dropped
and nothing repeats.

Weights are taken as they are, less their common divisor, while their sum is at
most CYCLE; beyond that they are rounded to CYCLE slots, or to FINE slots a
source if that is more.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Documents in a block; slots of a cycle for which weights need no rounding; slots a source beyond; slots worked out before their picks are laid by.
BLOCK, CYCLE, FINE, STRIDE = 16, 1 << 18, 64, 512
#: Documents of a source that are numbered together; above SPLIT times that, an id's rows are numbered by themselves.
GROUP, SPLIT = 1024, 8
#: Slots and sources up to which the cycle is sent to all tasks: 8 bytes a slot, about 100 a source.
SENT_SLOTS, SENT_SOURCES = 1 << 20, 1 << 15

# jobs: for each slot the blocks released there, as due * n + number of the source; ready: those not placed yet, in order
_EDF = """
aggregate(jobs, struct(b.ready AS ready, cast(array() AS array<bigint>) AS picks),
  (a, now) -> transform(array(sort_array(concat(a.ready, now))), r -> struct(slice(r, 2, size(r)) AS ready, concat(a.picks, array(r[0] % n)) AS picks))[0])"""
# a stride of slots at a time, so that what is placed already is not copied for each slot
_STRIDES = """
aggregate(strides, struct(cast(array() AS array<bigint>) AS ready, cast(array() AS array<array<bigint>>) AS done),
  (b, jobs) -> transform(array({edf}), e -> struct(e.ready AS ready, concat(b.done, array(e.picks)) AS done))[0],
  b -> flatten(b.done))"""


def _whole(weights: DataFrame) -> DataFrame:
    """(key, s, q, n): weights without their common divisor, rounded if their sum is too large; q: their sum, n: their number."""
    one = weights.agg(F.sum("s").alias("total"), F.count("*").alias("n"), F.expr("reduce(collect_set(s), 0L, (a, x) -> aggregate(sequence(1, 90), struct(a AS a, x AS b), (g, i) -> if(g.b = 0, g, struct(g.b AS a, g.a % g.b AS b))).a)").alias("d"))
    many = weights.crossJoin(F.broadcast(one))  # one row
    slots = f"greatest({CYCLE}L, {FINE}L * n)"
    fits = f"total div d <= {CYCLE}L"
    rounded = many.select("key", F.expr(f"if({fits}, s div d, greatest(1L, cast(round(s * ({slots} / total)) AS bigint)))").alias("s"), "n")
    return rounded.crossJoin(F.broadcast(rounded.agg(F.sum("s").alias("q")))).select("key", "s", "q", "n")


def cycle(weights: DataFrame) -> DataFrame:
    """(key, s, q, slots): the slots in the cycle of each source's blocks, in order, from weights (key, s: long above 0).

    Blocks are laid out by the slot that releases them.  What is gone through in
    order is one row of q longs; a slot costs a sort of the blocks that wait, of
    which a source has two at most.
    """
    numbered = written(_whole(weights).withColumn("i", F.row_number().over(Window.orderBy("key")).cast("long") - 1), "weights")
    jobs = numbered.select("i", "s", "q", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("j"))
    jobs = jobs.select(F.expr("(j * q) div s").alias("slot"), F.expr("(((j + 1) * q + s - 1) div s) * n + i").alias("job"))
    every = numbered.select("q").limit(1).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("slot"))
    at = every.join(jobs.groupBy("slot").agg(F.collect_list("job").alias("jobs")), "slot", "left").select("slot", F.coalesce("jobs", F.array().cast("array<bigint>")).alias("jobs"))
    strides = at.groupBy(F.expr(f"slot div {STRIDE}").alias("stride")).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "jobs"))), lambda x: x["jobs"]).alias("jobs"))
    laid = strides.agg(F.transform(F.array_sort(F.collect_list(F.struct("stride", "jobs"))), lambda x: x["jobs"]).alias("strides"))
    laid = laid.crossJoin(F.broadcast(numbered.select("n").limit(1)))
    placed = laid.select(F.posexplode(F.expr(_STRIDES.format(edf=_EDF))).alias("slot", "i"))
    own = placed.groupBy("i").agg(F.sort_array(F.collect_list(F.col("slot").cast("long"))).alias("slots"))
    return numbered.join(own, "i").select("key", "s", "q", "slots")


def root_weights(counts: DataFrame) -> DataFrame:
    """(key, s) from (key, n): the square root of a source's size, rounded down."""
    return counts.select("key", F.floor(F.sqrt("n")).cast("long").alias("s"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _group(total: int) -> Column:
    """The first digits of the hash, as many as leave about GROUP rows in a group."""
    digits = 0
    while total > GROUP * 16**digits:
        digits += 1
    return F.substring("_hash", 1, digits) if digits else F.lit("")


def _grouped(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keyed with _group and _order, and (key, group, n): rows of a group are numbered in the order of _order.

    Groups are beginnings of the hash of the id.  Where one has too many rows, ids
    with too many are groups by themselves, split by a number that a written
    table holds, as hashes of nothing but their values are equal for equal rows.
    """
    total = keyed.count()
    dealt = keyed.withColumn("_group", _group(total))
    sizes = written(dealt.groupBy("_key", "_group").agg(F.count("*").alias("_n")), "sizes")
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= SPLIT * GROUP:
        return dealt.withColumn("_order", F.col("_hash")), sizes
    hot = keyed.groupBy("_key", "_hash").agg(F.count("*").alias("_c")).where(F.col("_c") > GROUP)
    parts = F.expr(f"cast(pmod(xxhash64(_salt), _c div {GROUP} + 1) AS string)")
    marked = keyed.withColumn("_salt", F.monotonically_increasing_id()).join(hot, ["_key", "_hash"], "left")
    # an id's own groups come after the group that its hash begins with
    dealt = written(marked.withColumn("_group", F.when(F.col("_c").isNull(), _group(total)).otherwise(F.concat(_group(total), F.lit("~"), "_hash", F.lit("~"), parts))).drop("_c", "_salt"), "dealt")
    return dealt.withColumn("_order", F.col("_hash")), dealt.groupBy("_key", "_group").agg(F.count("*").alias("_n"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with _block, _place and _slot: its block in its source, its place there, and the block's slot in the mix.

    weights: (source, s) with integers s above 0; by the square root of the
    sources' sizes unless given.  A source without a weight is not mixed in: it
    is left out.  The order within a source is by the MD5 of doc_id, then doc_id;
    rows of one doc_id are in any order, and those of an id with more than GROUP
    of them may come later.  A null source is a source of its own, a null doc_id
    comes first.  Columns of docs by the three names are replaced, all others
    come through whatever their names.  Documents are numbered in groups of about
    GROUP by the hash's first digits, so a source with most of them fills many
    tasks.  Without documents: no rows.
    """
    kept = [c for c in docs.columns if c not in ("_block", "_place", "_slot")]
    tick = lambda c: "`" + c.replace("`", "``") + "`"
    keyed = docs.select(
        _key(F.col(tick(source_col))).alias("_key"), F.coalesce(F.md5(F.col(tick(id_col)).cast("string")), F.lit("")).alias("_hash"),
        F.col(tick(id_col)).alias("_id"), F.struct(*[F.col(tick(c)) for c in kept]).alias("_row"),
    )
    dealt, sizes = _grouped(keyed)
    counts = sizes.groupBy(F.col("_key").alias("key")).agg(F.sum("_n").alias("n"))
    if weights is None:
        weights = root_weights(counts)
    else:
        weights = weights.select(_key(F.col(source_col)).alias("key"), F.col("s").cast("long").alias("s")).join(counts.select("key"), "key", "left_semi")
    before = sizes.select("_key", "_group", (F.sum("_n").over(Window.partitionBy("_key").orderBy("_group")) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("_key", "_group").orderBy("_order", "_id")
    ranked = dealt.withColumn("_own", F.row_number().over(own)).join(before, ["_key", "_group"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    blocks = ranked.select("_key", "_row", F.expr(f"_rank div {BLOCK}").alias("_b"), F.expr(f"cast(_rank % {BLOCK} AS int)").alias("_p"))
    slots = written(cycle(weights), "cycle")
    size = slots.agg(F.max("q").alias("q"), F.count("*").alias("n")).first()
    if (size["q"] or 0) <= SENT_SLOTS and size["n"] <= SENT_SOURCES:
        placed = blocks.join(F.broadcast(slots.withColumnRenamed("key", "_key")), "_key").withColumn("_at", F.expr("slots[cast(_b % s AS int)]"))
    else:
        each = slots.select(F.col("key").alias("_key"), "s", "q", F.posexplode("slots").alias("_k", "_at"))
        shares = slots.select(F.col("key").alias("_key"), F.col("s").alias("_s"))
        placed = blocks.join(shares, "_key").withColumn("_k", F.expr("cast(_b % _s AS int)")).join(each, ["_key", "_k"])
    return placed.select("_row.*", F.col("_b").alias("_block"), F.col("_p").alias("_place"), F.expr("(_b div s) * q + _at").alias("_slot"))


def schedule(docs: DataFrame) -> DataFrame:
    """(doc_id, source, block, place, slot) of every row of docs; see mixed."""
    return mixed(docs.select("doc_id", "source")).select("doc_id", "source", F.col("_block").alias("block"), F.col("_place").alias("place"), F.col("_slot").alias("slot"))
