"""Mixing sources to target weights: multinomial draws of blocks, mapped through permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import drop, running_offsets, sums_before, word_count, written

ROUNDS = 24


def _uniform(*keys) -> Column:
    """A hash of the keys in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def permuted(x: Column, n: Column, seed: list[Column], inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1 at x: the swap-or-not shuffle (Hoang, Morris, Rogaway 2012).

    Each round pairs x with k - x mod n and swaps the two on a hash bit of the greater; a round is its
    own inverse, so that the rounds backwards undo it.
    """

    def one(x, r):
        k = F.pmod(F.xxhash64(r, *seed), n)
        other = F.pmod(k - x, n)
        return F.when(F.xxhash64(r, F.greatest(x, other), *seed) % 2 == 0, other).otherwise(x)

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, x, one)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> also src (rank by code point, null last), weight, target.

    Targets share `share` of all sizes by weight but stop at cap * source_size, the excess reshared by
    weight until none is above. In order of size per weight the capped sources come first, so one
    window finds them. The table has one row per source, not per document.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = sizes.withColumn("src", rank.cast("int"))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("src") % len(weights) + 1))
    every = Window.partitionBy(F.lit(0))
    src = src.withColumns({"most": F.lit(cap) * F.col("source_size"), "budget": F.lit(share) * F.sum("source_size").over(every)})
    before = Window.orderBy(F.col("most") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    src = src.withColumns({"taken_before": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    src = src.withColumn("capped", F.col("most") * F.col("weight_left") <= (F.col("budget") - F.col("taken_before")) * F.col("weight"))
    free = F.col("budget") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(every)
    per_weight = free / F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(every)
    return src.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * per_weight)).select("source", "source_size", "src", "weight", "target")


def _slots(src: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """One row a slot of the mix: src, block index, words taken from the block's start, and the output shard.

    src needs src, source_size, target. A source's slots run through its blocks in permuted order, pass
    after pass, until its target is met; the last is cut, so the words taken are the target, rounded.
    """
    src = src.where("source_size > 0").withColumns({"goal": F.least(F.round("target").cast("long"), (2 * F.col("source_size")).cast("long")), "blocks": F.expr(f"source_size div {block} + if(source_size % {block} > 0, 1, 0)"), "short": F.expr(f"{block} - 1 - (source_size - 1) % {block}")})
    spark = src.sparkSession
    # Enough slots: a pass ends after all blocks; what is left needs one more if the short block is in it.
    src = src.withColumn("slots", F.expr(f"goal div source_size * blocks + least(blocks, (goal % source_size) div {block} + 2)")).where("goal > 0")
    every = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy(F.lit(0)).orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    src = src.withColumns({"share": F.col("slots") / F.sum("slots").over(every), "hi": F.sum("slots").over(upto) / F.sum("slots").over(every)})
    src = src.withColumn("lo", F.col("hi") - F.col("share"))
    src = written(src, "mix-src")
    total, sources = src.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    shards, bins = max(1, -(-total // shard_slots)), 64 + 4 * sources
    # Multinomial counts: each slot of a shard draws u; equal bins of u make the range lookup an equi-join.
    spans = src.select("src", "lo", "hi", F.explode(F.sequence(F.least((F.col("lo") * bins).cast("long"), F.lit(bins - 1)), F.least((F.col("hi") * bins).cast("long"), F.lit(bins - 1)))).alias("bin"))
    draws = spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), _uniform(F.lit(seed), F.col("id")).alias("u"))
    draws = draws.withColumn("bin", (F.col("u") * bins).cast("long")).join(spans, "bin").where("u >= lo and u < hi")
    counts = written(draws.groupBy("src", "shard").agg(F.count("*").alias("n")), "mix-counts")
    # The draws' sums are brought to the slots each source needs, in proportion along the shards.
    drawn = counts.groupBy("src").agg(F.sum("n").alias("drawn"))
    counts = sums_before(counts, "src", "shard", "n", "to", shards).withColumn("to", F.col("to") + F.col("n")).join(drawn, "src")
    some = src.join(counts, "src", "left").withColumns({"shard": F.coalesce("shard", F.pmod(F.xxhash64("src"), F.lit(shards))), "from": F.coalesce(F.expr("cast(cast(slots as decimal(19,0)) * cast(to - n as decimal(19,0)) div cast(drawn as decimal(19,0)) as long)"), F.lit(0)), "to": F.coalesce(F.expr("cast(cast(slots as decimal(19,0)) * cast(to as decimal(19,0)) div cast(drawn as decimal(19,0)) as long)"), F.col("slots"))})
    # A row here stands for a thousand slots: they are dealt out before each is permuted.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 200_000))
    some = some.where("to > from").repartition(parts, "src", "shard").withColumn("slot", F.explode(F.expr("sequence(from, to - 1)")))
    some = some.withColumns({"pass": F.expr("slot div blocks"), "at": F.expr("slot % blocks")})
    seeds = [F.lit(seed), F.col("src"), F.col("pass")]
    some = some.withColumns({"block": permuted(F.col("at"), F.col("blocks"), seeds), "short_at": permuted(F.col("blocks") - 1, F.col("blocks"), seeds, inverse=True)})
    length = F.lit(block) - F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(0)
    before = F.col("pass") * F.col("source_size") + F.col("at") * block - F.when(F.col("at") > F.col("short_at"), F.col("short")).otherwise(0)
    some = some.withColumn("words", F.least(length, F.col("goal") - before))
    return some.where("words > 0").select("src", "block", "words", "shard")


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 256, shard_slots: int = 1024, seed: int = 20) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Each source's documents are laid end to end, in order of a hash, and cut into blocks of `block` words.
    Every output shard of `shard_slots` slots draws its source counts from a multinomial in proportion to
    the slots that the targets need; a source's slots are mapped through a pseudorandom permutation of its
    blocks, another one each pass, and joined with the documents by block index. A document's `taken`
    is the overlap of its words with the blocks taken. With a cap of 2, none is taken more than twice.

    Columns: doc_id, size (words; null text: 0), source, source_size, target, taken. Empty texts have taken 0;
    a null source is a source, the last; repeated rows are documents of their own; an empty table gives no
    rows; other columns are ignored. Reruns agree: everything is drawn from hashes.
    """
    base = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-docs")
    src = written(source_targets(base.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, cap), "mix-sources")
    rows = base.join(src.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    laid = written(running_offsets(rows, "src", ["doc_id", "size"], F.col("size"), "start", base.count()), "mix-laid")
    pieces = laid.where("size > 0").select("doc_id", "src", "size", "start", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    slots = _slots(src, block, shard_slots, seed)
    drop(base, src)
    overlap = F.least(F.expr(f"block * {block}") + F.col("words"), F.col("start") + F.col("size")) - F.greatest(F.expr(f"block * {block}"), F.col("start"))
    taken = pieces.join(slots, ["src", "block"]).groupBy("src", "start").agg(F.sum(F.greatest(overlap, F.lit(0))).alias("taken"))
    # Within a source, only rows with words have a start of their own.
    out = laid.withColumn("_start", F.when(F.col("size") > 0, F.col("start"))).join(taken.withColumnRenamed("start", "_start"), ["src", "_start"], "left")
    return out.select("doc_id", F.col("size").cast("long").alias("size"), "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each whole copy, in place of a document's share of words taken.

    taken / size, rounded up or down by a hash of the document, is the number of copies (0, 1 or 2), so
    sources keep their targets in the mean. Documents without words are left as they are. Rows that share
    doc_id, source and size share their decision. All columns of docs are kept, whatever their names.
    """
    mix = mix_sources(docs, **options)
    copies = F.floor(F.col("taken") / F.col("size") + _uniform(F.lit("copy"), F.col("doc_id"), F.col("size"), F.col("taken")))
    mix = mix.where("size > 0").select(F.col("doc_id").alias("_d"), F.col("size").alias("_n"), F.col("source").alias("_s"), copies.cast("int").alias("_copies"))
    mix = mix.groupBy("_d", "_n", "_s").agg(F.max("_copies").alias("_copies"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = rows.withColumns({"_words": word_count(F.col("_row.text"))})
    out = rows.join(mix.hint("merge"), F.col("_row.doc_id").eqNullSafe(F.col("_d")) & (F.col("_words") == F.col("_n")) & F.col("_row.source").eqNullSafe(F.col("_s")), "left")
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("_copies", F.lit(1)))))
    return out.select("_row.*")
