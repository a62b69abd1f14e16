"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Document rates r, the expected number of copies, stay as near to one each as the token constraints allow: they minimise
sum r log r - r + 1 over documents, under sum size * r = target for each source and r <= MOST. The dual is convex; its solution tilts
each document exponentially in what the constraint weighs it by, r = min(MOST, exp(l * size / mean size)), with one multiplier l a source.
Newton finds the multipliers of all sources together: each iteration is one distributed aggregation that gives, for each source,
the words taken at its multiplier and their slope, and takes a step on their logarithm, or halves the bracket where a step would leave
it. What is iterated over is the table of (source, size, number of documents), made once by partial aggregation, so an iteration doesn't
touch documents, and no source, however large, is a group in one task. Sums are decimals, so reruns agree to the last bit.

Rates are then rounded into whole copies: in salted buckets of a source, in order of size, a copy is added each time the running sum of rates'
fractions passes one more half, what remains is evened out over the smallest documents, and then a few times by the document
whose size fits best, so a bucket misses its share by less than one small document. No bucket grows with its source.

Null text: size 0. Documents without words have rate 1. Null sources are one source, listed last. Null or repeated ids: rows are
mixed like others, ties go by id and then by a hash of the text. Tables without words give targets 0. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import common

WEIGHTS, MOST, BUCKET_ROWS, MENDS = (1.0, 2.0, 3.0), 3, 2_000, 3
#: Newton: steps at most, and the residual, relative to the target, at which it ends.
STEPS, PRECISION = 80, 1e-10


def n_words(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D, as a long; 0 for null."""
    spaced = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(spaced), F.lit(0)) == 0, 0).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n_rows, source_size, target. Water filling: a target is the less of most * size and level * weight, and the
    level is read off the sources in order of most * size / weight. Rows are one for each source, so one task orders them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.lit(float(most)) * F.col("source_size")
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    rows = sizes.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("w_all", F.sum("w").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    )
    # The level if this source and all of a larger ratio stay below their caps. Valid levels fall with the ratio; the first is right.
    level = (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before"))
    rows = rows.withColumn("level", F.when(level <= F.col("ratio"), level))
    rows = rows.withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return rows.select("source", "n_rows", "source_size", target.alias("target"))


def solved(histogram: DataFrame, goals: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """source, multiplier, residual (of the target, relative to it) and steps. histogram: source, size, n_docs, without size 0;
    goals: source, source_size, mean_size, target. Sources whose target is 0, or all that they may give, need no multiplier: it is null."""
    top = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    open_ = goals.where(~top & (F.col("target") > 0)).select(F.col("source").alias("of"), "target", "mean_size")
    now = common.staged(open_.select("of", "target", "mean_size", F.lit(0.0).alias("l"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(1.0).alias("residual")), "multipliers")
    for _ in range(steps):
        x = F.col("size") / F.col("mean_size")
        tilt = F.exp(F.greatest(F.lit(-600.0), F.least(F.col("l") * x, F.log(F.lit(float(most))))))
        words = F.col("n_docs") * F.col("size") * tilt
        # Terms as decimals: their sum doesn't depend on its order.
        exact = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")
        slope = F.when(F.col("l") * x < F.log(F.lit(float(most))), words * x).otherwise(0.0)
        taken = histogram.join(now, F.col("source").eqNullSafe(F.col("of"))).groupBy("of", "target", "mean_size", "l", "low", "high").agg(exact(words).alias("taken"), exact(slope).alias("slope"))
        miss = F.col("taken") - F.col("target")
        low, high = F.when(miss < 0, F.col("l")).otherwise(F.col("low")), F.when(miss > 0, F.col("l")).otherwise(F.col("high"))
        # Newton on log(taken / target); outside of the bracket, half way in it, or on by doubling where there is no other end yet.
        newton = F.col("l") - F.log(F.greatest(F.col("taken"), F.lit(1e-9)) / F.col("target")) * F.col("taken") / F.col("slope")
        wide = F.when(F.col("high").isNull(), F.greatest(2 * F.col("l"), F.col("l") + 1)).when(F.col("low").isNull(), F.least(2 * F.col("l"), F.col("l") - 1)).otherwise((F.col("low") + F.col("high")) / 2)
        inside = (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton - F.col("l")) <= 4 * F.greatest(F.abs("l"), F.lit(1.0)))
        after = taken.select("of", "target", "mean_size", "l", low.alias("low"), high.alias("high"), (F.abs(miss) / F.col("target")).alias("residual"), "taken", "slope")
        step = F.when((F.col("slope") > 0) & inside, newton).otherwise(wide)
        after = after.select("of", "target", "mean_size", F.when(F.col("residual") <= PRECISION, F.col("l")).otherwise(step).alias("l"), "low", "high", "residual")
        after = common.staged(after, "multipliers")
        worst = after.agg(F.max("residual")).first()[0]
        common.dropped(now)
        now = after
        if worst is None or worst <= PRECISION:
            break
    return now.select(F.col("of").alias("source"), F.col("l").alias("multiplier"), "residual")


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size and a hash of the text of every row."""
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))


def planned(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: n_rows, source_size, target, mean_size, multiplier, residual."""
    histogram = common.staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")
    worded = F.sum(F.when(F.col("size") > 0, F.col("n_docs")))
    words = F.sum(F.col("size") * F.col("n_docs"))
    per_source = histogram.groupBy("source").agg(F.sum("n_docs").alias("n_rows"), words.alias("source_size"), (words / worded).alias("mean_size"))
    means = per_source.select(F.col("source").alias("of"), "mean_size")
    goals = targets(per_source.drop("mean_size"), weights, most).join(means, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    goals = common.staged(goals, "goals")
    found = solved(histogram.where("size > 0"), goals, most).withColumnRenamed("source", "of")
    common.dropped(histogram)
    # Written, so that its size is known: Spark sends it to all tasks if it is small, and shuffles it if not.
    return common.staged(goals.join(found, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "plan")


def rates(size: Column, most: int = MOST) -> Column:
    """A document's rate from its source's plan."""
    tilted = F.exp(F.least(F.col("multiplier") * size / F.col("mean_size"), F.log(F.lit(float(most)))))
    full = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    return F.when(size == 0, F.lit(1.0)).when(F.col("multiplier").isNull(), full).otherwise(F.least(F.lit(float(most)), tilted))


def balanced(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken, multiplier, residual: one row for each document. Texts are read once."""
    rows = common.staged(measured(docs), "sizes")
    found = mixed(rows, planned(rows, weights, most), most, bucket_rows)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return found.select("doc_id", "size", "source_size", "target", "rate", "copies", taken, "multiplier", "residual")


def mixed(rows: DataFrame, plan: DataFrame, most: int, bucket_rows: int) -> DataFrame:
    """The measured rows with what their source's plan and the rounding give them."""
    plan = plan.withColumn("n_buckets", F.ceil(F.col("n_rows") / bucket_rows)).drop("n_rows").withColumnRenamed("source", "of")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rates(F.col("size"), most))
    return rounded(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.col("n_buckets"))), most)


def rounded(rows: DataFrame, most: int = MOST) -> DataFrame:
    """copies and taken from rate, within (source, bucket); all windows share one exchange."""
    part = Window.partitionBy("source", "bucket")
    order = part.orderBy(F.col("size").desc(), "doc_id", "mark")
    whole, share = F.floor("rate"), F.col("rate") - F.floor("rate")
    rn = F.row_number().over(order)
    so_far = F.sum(share).over(order.rowsBetween(Window.unboundedPreceding, 0))
    extra = F.floor(so_far + 0.5) - F.floor(so_far - share + 0.5)
    rows = rows.withColumn("copies", F.least(F.lit(most).cast("long"), whole + extra))
    miss = F.round(F.sum(F.col("rate") * F.col("size")).over(part) - F.sum(F.col("copies") * F.col("size")).over(part)).cast("long")
    rows = rows.withColumn("miss", miss)
    up = (F.col("miss") > 0) & (F.col("copies") < most)
    down = (F.col("miss") < 0) & (F.col("copies") > 0)
    small = part.orderBy(F.col("size").asc(), "doc_id", "mark").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.sum(F.when(up | down, F.col("size")).otherwise(0)).over(small)
    mend = F.when(moved <= F.abs("miss"), F.when(up, 1).when(down, -1).otherwise(0)).otherwise(0)
    rows = rows.withColumn("copies", F.col("copies") + mend).withColumn("rn", rn)
    for _ in range(MENDS):
        rows = _mended(rows, part, most)
    return rows


def _mended(rows: DataFrame, part: WindowSpec, most: int) -> DataFrame:
    """One document of each bucket, that whose size is nearest to what is missing, gets a copy more or less if that helps."""
    miss = F.round(F.sum(F.col("rate") * F.col("size")).over(part) - F.sum(F.col("copies") * F.col("size")).over(part)).cast("long")
    rows = rows.withColumn("miss", miss)
    can = ((F.col("miss") > 0) & (F.col("copies") < most)) | ((F.col("miss") < 0) & (F.col("copies") > 0))
    off = F.abs(F.col("size") - F.abs("miss"))
    best = F.min(F.when(can & (off < F.abs("miss")), F.struct(off.alias("off"), F.col("rn")))).over(part)
    step = F.when(best["rn"] == F.col("rn"), F.signum("miss")).otherwise(0).cast("long")
    return rows.withColumn("copies", F.col("copies") + step)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, with all its columns. Rows are matched by id, source and text; those
    that agree in all three share their copies out evenly, in order of a hash of the whole row. Texts are shuffled once."""
    thin = common.staged(measured(docs), "sizes")
    found = mixed(thin, planned(thin, weights, most), most, BUCKET_ROWS)
    key, own, times, alike, rank = (common.fresh(docs, f"mixed_{n}") for n in ("key", "own", "times", "alike", "rank"))
    counts = found.groupBy(F.xxhash64("doc_id", "source", "mark").alias(own)).agg(F.sum("copies").alias(times), F.count(F.lit(1)).alias(alike)).where(F.col(times) > 0)
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text")))
    rows = rows.join(counts, F.col(key) == F.col(own))
    order = Window.partitionBy(key).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    rows = rows.withColumn(rank, F.row_number().over(order))
    copies = F.floor(F.col(times) / F.col(alike)) + (F.col(rank) <= F.pmod(F.col(times), F.col(alike))).cast("long")
    rows = rows.withColumn(times, copies).where(F.col(times) > 0)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(rank)).drop(rank)
