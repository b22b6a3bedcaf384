"""Mixing sources to target weights: fixed-length word blocks, drawn per output shard and joined by index.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of ``block`` words. Every
output shard draws a multinomial count of slots per source (the whole parts of the expectations are fixed, the rest is
drawn), slot ordinals run through a pseudorandom permutation of the source's block indices, and the blocks are joined
by index. DataFrame functions only. Running sums go over two levels of hash digits, so a source with a third of all
rows is spread over 65,536 groups; the joins are on (source, block index) and even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import bound, n_words, read_table, unused, words, written

WEIGHTS, MAX_REPEAT, BLOCK, SEED = (5.0, 2.0, 1.0), 3, 64, 17
MIN_SHARD_SLOTS, MAX_SHARDS = 4096, 8192
#: How many primes the step widths of the permutations are picked from.
N_STEPS = 16
WIDE = 3_000_000_000


def _steps(n: int) -> list[int]:
    """The n greatest primes under 2^31."""
    found, x = [], 2**31 - 1
    while len(found) < n:
        if all(x % d for d in range(3, int(x**0.5) + 1, 2)):
            found.append(x)
        x -= 2
    return found


def _step(n: Column, *keys: Column) -> Column:
    """A step width for n blocks, picked by the keys: without a common factor with n, and not 1 or -1 modulo n where n leaves the choice."""
    n = F.greatest(n, F.lit(1))
    steps, first = F.array(*map(F.lit, _steps(N_STEPS))), F.pmod(F.xxhash64(*keys), F.lit(N_STEPS)).cast("int")
    turned = F.concat(F.slice(steps, first + 1, F.lit(N_STEPS)), F.slice(steps, F.lit(1), first))
    good = F.filter(turned, lambda p: (p % n > 1) & (p % n < n - 1))
    return F.coalesce(F.get(good, F.lit(0)) % n, F.lit(1).cast("long"))


def _uniform(*cols: Column) -> Column:
    """A pseudorandom double in [0, 1) of the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0**-53)


def _targets(sources: DataFrame, weights: tuple[float, ...], max_repeat: int, block: int) -> DataFrame:
    """Adds rank, target and slots to one row per source. Targets rise together until each meets its cap."""
    everything = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("w", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)))
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * max_repeat).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    out = level.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("w")))
    out = out.withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    slots = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)
    out = out.withColumn("slots", slots).withColumn("all_slots", F.sum(slots).over(everything)).withColumn("n_sources", F.count("*").over(everything))
    return out.select("n_sources", "skey", "rank", "source_size", "target", "n_blocks", "slots", "all_slots")


def _block_uses(sources: DataFrame, max_repeat: int, seed: int) -> DataFrame:
    """How often each block is taken: (skey, idx, uses), blocks that are never taken left out."""
    total = F.floor(F.col("all_slots") + 0.5)
    width = F.greatest(F.lit(MIN_SHARD_SLOTS), F.ceil(total / MAX_SHARDS), F.col("n_sources") * 4)  # shards times sources: a quarter of the slots at most
    plan = sources.where(F.col("slots") > 0).withColumn("total", total).withColumn("width", width)
    plan = plan.where(F.col("total") > 0).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / F.col("width")))))
    size = F.least(F.col("width"), F.col("total") - F.col("shard") * F.col("width"))
    share = size * F.col("slots") / F.col("all_slots")
    plan = plan.withColumn("base", F.floor(share)).withColumn("frac", share - F.floor(share)).withColumn("size", size)
    shard = Window.partitionBy("shard")
    plan = plan.withColumn("at", F.coalesce(F.sum("frac").over(shard.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    plan = plan.withColumn("left", F.col("size") - F.sum("base").over(shard)).withColumn("frac_all", F.sum("frac").over(shard)).withColumn("first", F.row_number().over(shard.orderBy("rank")) == 1)
    bounds = plan.where(F.col("frac") > 0).select("shard", F.col("at").alias("u"), F.lit(0).alias("kind"), "rank", "skey")
    draws = (plan.where(F.col("first") & (F.col("left") > 0)).select("shard", "frac_all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))).alias("draw"))
             .select("shard", (_uniform(F.lit(seed), F.col("shard"), F.col("draw")) * F.col("frac_all")).alias("u"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("skey")))
    drawn = bounds.unionByName(draws).withColumn("skey", F.last("skey", ignorenulls=True).over(shard.orderBy("u", "kind", "rank"))).where(F.col("kind") == 1)
    counts = plan.select("shard", "skey", "base").unionByName(drawn.select("shard", "skey", F.lit(1).cast("long").alias("base")))
    counts = counts.groupBy("shard", "skey").agg(F.sum("base").alias("n")).where(F.col("n") > 0)
    start = F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("start", start).join(sources.select("skey", "rank", "n_blocks"), "skey")
    # one step for each source and pass, found before the slots are exploded
    steps = F.array(*[_step(F.col("n_blocks"), F.lit(seed), F.col("rank"), F.lit(e)) for e in range(max_repeat)])
    counts = counts.join(sources.select("skey", steps.alias("steps")), "skey")
    slots = counts.withColumn("ordinal", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1))).where(F.col("ordinal") < F.col("n_blocks") * max_repeat)
    n, epoch = F.col("n_blocks"), F.floor(F.col("ordinal") / F.col("n_blocks"))
    r, shift = F.col("ordinal") % n, F.pmod(F.xxhash64(F.lit(seed), F.col("rank"), epoch), n)
    step = F.get(F.col("steps"), epoch.cast("int"))
    wide = ((r.cast("decimal(19,0)") * step.cast("decimal(18,0)") + shift) % n).cast("long")
    return slots.select("skey", F.when(n < WIDE, (r * step + shift) % n).otherwise(wide).alias("idx")).groupBy("skey", "idx").agg(F.count("*").alias("uses"))


def _laid_out(docs: DataFrame, weights: tuple[float, ...], max_repeat: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """One light row per document with its place in its source's stream, and the uses of the blocks."""
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    light = written(docs.select("doc_id", "source", skey.alias("skey"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), n_words(F.col("text")).alias("size")), "sizes")
    light = light.withColumn("b1", F.pmod("h", F.lit(256))).withColumn("b2", F.pmod(F.shiftright("h", 8), F.lit(256)))
    fine = light.groupBy("skey", "source", "b1", "b2").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("skey", "source", "b1").agg(F.sum("n").alias("n"))
    sources = written(_targets(coarse.groupBy("skey", "source").agg(F.sum("n").alias("source_size")), weights, max_repeat, block), "sources")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("skey", "b1", F.coalesce(F.sum("n").over(before("skey", "b1")), F.lit(0)).alias("at1")).join(sources.select("skey", "source_size", "target"), "skey")
    fine = fine.select("skey", "b1", "b2", F.coalesce(F.sum("n").over(before("skey", "b1", "b2")), F.lit(0)).alias("at2")).join(coarse, ["skey", "b1"])
    group = Window.partitionBy("skey", "b1", "b2").orderBy("h", "doc_id", "size")
    placed = light.withColumn("rn", F.row_number().over(group)).withColumn("at3", F.coalesce(F.sum("size").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(fine, ["skey", "b1", "b2"]).withColumn("at", F.col("at1") + F.col("at2") + F.col("at3"))
    return placed.select("doc_id", "skey", "h", "size", "b1", "b2", "rn", "at", "source_size", "target"), _block_uses(sources, max_repeat, seed)


def _pieces(placed: DataFrame, uses: DataFrame, block: int) -> DataFrame:
    """A row for each document and block that overlap, with where the overlap starts, its length and its uses."""
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = placed.withColumn("idx", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block), last))))
    low, high = F.greatest(F.col("at"), F.col("idx") * block), F.least(F.col("at") + F.col("size"), (F.col("idx") + 1) * block)
    cut = cut.withColumn("start", low - F.col("at")).withColumn("n", high - low)
    return cut.join(uses, ["skey", "idx"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def mix_counts(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """For every document its size, its source's size and target, and how many of its words the mix takes.

    Needs doc_id, text and source; other columns are ignored, whatever their names. Null and empty texts have size 0
    and are taken 0 times. A null source is a source of its own, ranked last. Every row counts, repeated ones too:
    each has its own place in the stream. An empty table gives an empty result. Results depend on rows and seed only.
    """
    placed, uses = _laid_out(docs, weights, max_repeat, block, seed)
    taken = F.coalesce(F.sum(F.col("n") * F.col("uses")), F.lit(0)).alias("taken")
    return (_pieces(placed, uses, block).groupBy("skey", "b1", "b2", "rn", "doc_id", "size")
            .agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), taken)
            .select("doc_id", "size", "source_size", "target", "taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixed corpus: one row per document that the mix takes words of, ``text`` being those words, repeats included.

    A pass over a document that takes all its words keeps the text as it is; a pass that takes some joins these words
    by spaces; passes are joined by a line break. ``n_chars``, where present, follows; other columns pass through.
    Rows that repeat a document (same doc_id and text) become one row. Documents of which no word is taken go.
    """
    placed, uses = _laid_out(docs, weights, max_repeat, block, seed)
    d, h, size, pieces = (unused(c, docs) for c in ("d", "h", "size", "pieces"))
    taken = (_pieces(placed, uses, block).where(F.col("uses") > 0).groupBy(F.coalesce("doc_id", F.lit(-1)).alias(d), F.col("h").alias(h))
             .agg(F.max("size").alias(size), F.array_sort(F.collect_list(F.struct("rn", "start", "n", "uses"))).alias(pieces)))
    keyed = docs.withColumns({d: F.coalesce("doc_id", F.lit(-1)), h: F.xxhash64(F.lit(seed), "doc_id", "text")})
    full = keyed.join(taken, [d, h]).dropDuplicates([d, h])

    def one_pass(e: Column, ws: Column) -> Column:
        some = F.filter(pieces, lambda p: p.uses >= e)
        n = F.aggregate(some, F.lit(0).cast("long"), lambda a, p: a + p.n)
        part = F.array_join(F.flatten(F.transform(some, lambda p: F.slice(ws, (p.start + 1).cast("int"), p.n.cast("int")))), " ")
        return F.when(n == F.col(size), F.col("text")).otherwise(part)

    most = F.aggregate(pieces, F.lit(1).cast("long"), lambda a, p: F.greatest(a, p.uses))
    passes = F.sequence(F.lit(1).cast("long"), most)
    out = full.withColumn("text", bound(words(F.col("text")), lambda ws: F.array_join(F.transform(passes, lambda e: one_pass(e, ws)), "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(read_table(spark, sf_dir, "documents"))
