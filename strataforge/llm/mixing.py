"""Mixing sources to target weights by Pareto order sampling, as DataFrame operations only.

A source's target is its weight's share of a budget of words, at most
MOST_COPIES times its size; what is cut off is shared again by weight until no
target is above that. Within a source a document is expected in e copies, in
proportion to a weight of its length class and at most MOST_COPIES: floor(e)
whole copies are certain, and the rest p = e - floor(e) is an inclusion
probability. Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)) (Rosen 1997), and each source takes the head of its
ranking, a sample of fixed size in words: it ends where the words taken come
nearest to the target. u is a hash of the id, so reruns agree.

No ranking is sorted whole. Odds are mapped to (0, 1) and counted in BUCKETS
ranges a source; only the range in which a source's head ends is sorted, and the
last document taken becomes the source's cut-off, with which every row decides
by itself.

Edge cases: a null text has no words; a null source is a source of its own, the
last one; null and repeated doc_ids share one draw, so such rows are taken or
left together. A source without words has target 0, and a document without words is not taken. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key() -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _length_class() -> Column:
    """Bits of the number of words."""
    return F.length(F.bin("size"))


def _length_weight() -> Column:
    """Inclusion leans to longer texts, by about 1 to 3; whole numbers keep sums exact."""
    return F.col("level") + 4


def _draw() -> Column:
    """A number in (0, 1) from the id's MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def _levelled(frame: DataFrame, group: list[str], amount: Column, cap: Column, weight: Column, order: list[Column]) -> DataFrame:
    """Water-filling: share ``amount`` over a group's rows by weight, none above its cap; adds level, capped.

    Rows ordered by cap over weight are capped as long as the level that remains
    for the others reaches them. ``cap`` and ``weight`` are whole numbers, so running sums are exact.
    """
    over = Window.partitionBy(*group)
    before = over.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = frame.withColumns({"_cap": cap.cast("double"), "_weight": weight.cast("double"), "_amount": amount})
    here = here.withColumns({"_caps_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_weights_from": F.sum("_weight").over(over) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))})
    here = here.withColumn("capped", (F.col("_weight") == 0) | (F.col("_cap") * F.col("_weights_from") <= (F.col("_amount") - F.col("_caps_before")) * F.col("_weight")))
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("_weight"))).over(over)
    used = F.sum(F.when(F.col("capped"), F.col("_cap")).otherwise(0.0)).over(over)
    here = here.withColumn("level_of", F.when(free > 0, (F.col("_amount") - used) / free))
    return here.drop("_amount", "_caps_before", "_weights_from")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sizes (key, source, size) -> key, source_size, target. One row a source, so the windows see sources, not documents."""
    per = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = per.withColumn("weight", weight)
    total = F.sum("source_size").over(Window.partitionBy())
    level = _levelled(ranked, [], share * total, most * F.col("source_size"), F.col("weight"), [(F.col("_cap") / F.col("_weight")).asc(), F.col("source").asc_nulls_last()])
    return level.select("key", "source_size", F.when(F.col("capped"), F.col("_cap")).otherwise(F.col("level_of") * F.col("_weight")).alias("target"))


def _position() -> Column:
    """Pareto rank mapped to (0, 1): odds q become q / (1 + q)."""
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    return F.when(F.col("p") > 0, odds / (1 + odds))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sized (doc_id, source, size) -> key, level, source_size, target, whole, p, last: what rows need to decide.

    One row for each source and length class; ``last`` is the source's cut-off (position, doc_id, size).
    """
    slim = sized.select("doc_id", "source", "size").withColumns({"key": _source_key(), "level": _length_class()})
    classes = slim.groupBy("key", "source", "level").agg(F.sum("size").alias("size"))
    aims = targets(classes, weights, share, most)
    joined = classes.groupBy("key", "level").agg(F.sum("size").alias("class_size")).join(aims, "key")
    shared = _levelled(joined, ["key"], F.col("target"), most * F.col("class_size"), _length_weight() * F.col("class_size"), [_length_weight().desc()])
    copies = F.when(F.col("capped"), F.lit(float(most))).otherwise(F.col("level_of") * _length_weight())
    shared = shared.withColumn("copies", copies).withColumn("whole", F.floor("copies"))
    certain = F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("key"))
    shared = written(shared.select("key", "level", "source_size", "target", "whole", (F.col("copies") - F.col("whole")).alias("p"), (F.col("target") - certain).alias("rest")), "classes")
    drawn = slim.join(shared, ["key", "level"]).filter("p > 0 and size > 0").withColumn("u", _draw()).withColumn("position", _position())
    drawn = drawn.select("key", "doc_id", "size", "rest", "position", F.floor(F.col("position") * BUCKETS).alias("bucket"))
    counted = drawn.groupBy("key", "bucket").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
    upto = F.sum("size").over(Window.partitionBy("key").orderBy("bucket"))
    ends = counted.withColumn("upto", upto).filter("upto >= rest and upto - size < rest").select("key", "bucket", (F.col("upto") - F.col("size")).alias("before"))
    ends = written(ends, "ends")
    order = [F.col("position"), F.col("doc_id"), F.col("size")]
    peers = Window.partitionBy("key").orderBy(*order)  # rows that tie are counted together
    inside = drawn.join(ends, ["key", "bucket"]).withColumns({"upto": F.col("before") + F.sum("size").over(peers), "own": F.sum("size").over(Window.partitionBy("key", *order))})
    head = inside.filter("upto - own < rest and upto + (upto - own) <= 2 * rest").groupBy("key").agg(F.max(F.struct("position", "doc_id", "size")).alias("found"))
    # A head that ends with a range, or takes everything, has no row in the range that follows.
    cut = ends.join(head, "key", "left").select("key", F.coalesce(F.col("found.position"), F.col("bucket") / BUCKETS).alias("cut_position"), F.col("found.doc_id").alias("cut_doc_id"), F.col("found.size").alias("cut_size"), F.col("found").isNotNull().alias("cut_inside"))
    return shared.join(cut, "key", "left")


def decide(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, ...) with source_size, target, copies and taken, each row deciding by its source's plan.

    The plan has a row for each source and length class; it is joined as its size allows.
    """
    keyed = rows.withColumns({"key": _source_key(), "level": _length_class()}).join(made, ["key", "level"], "left").withColumn("u", _draw()).withColumn("position", _position())
    own = F.struct(F.col("position"), F.col("doc_id"), F.col("size"))
    last = F.struct(F.col("cut_position").alias("position"), F.col("cut_doc_id").alias("doc_id"), F.col("cut_size").alias("size"))
    drawn = F.col("position").isNotNull() & (F.col("size") > 0) & (F.col("rest") > 0) & F.when(F.col("cut_position").isNull(), True).when(F.col("cut_inside"), own <= last).otherwise(F.col("position") < F.col("cut_position"))
    copies = (F.col("whole") + F.coalesce(drawn, F.lit(False)).cast("long")).cast("long")
    return keyed.withColumn("copies", F.when(F.col("size") > 0, F.coalesce(copies, F.lit(0))).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size")).drop("key", "level", "whole", "p", "rest", "cut_position", "cut_doc_id", "cut_size", "cut_inside", "u", "position")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each row."""
    sized = written(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")), "sizes")
    return decide(sized, written(plan(sized), "plan")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Texts are not shuffled unless the plan outgrows a broadcast."""
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", words_in(F.col("text")).alias("size"))
    made = written(plan(written(sized.select("doc_id", "source", "size"), "sizes")), "plan")
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>"))
    return decide(sized, made).withColumn("copy", F.explode(copies)).select("row.*")
