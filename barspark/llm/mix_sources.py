"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Words in a block, about how many words of its source a shard holds, and shards in a group: small blocks cost nothing, as none becomes a row.
BLOCK_WORDS, SHARD_WORDS, GROUP = 64, 100_000, 4096
#: Copies of a row that one task numbers at a time.
COPIES = 65_536
#: A prime above any number of blocks in a shard: multiplying by it permutes the blocks.
STRIDE = 2_147_483_647
#: So many rows of sources or quotas (some 50 bytes each) are broadcast; more are shuffled.
SMALL = 50_000


def apportion(rows: DataFrame, weight: str, seats: str, order: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``quota``: the group's ``seats`` dealt by highest quotients ``weight / (2 k + 1)``.

    A divisor that surely deals no more than the seats gives each row its first ones at once; the rest, at most one a row
    on average, goes by ranked quotients (ties: ``order``). ``seats`` is equal within a group; weightless rows get none."""
    w = Window.partitionBy(*by)
    total, n = F.sum(weight).over(w), F.sum((F.col(weight) > 0).cast("double")).over(w)
    x = rows.withColumns({"__w": total, "__n": n})
    first = F.when((F.col("__w") > 0) & (F.col(seats) > F.col("__n") / 2), F.floor(F.col(weight) * (F.col(seats) - F.col("__n") / 2) / F.col("__w") + F.lit(0.5))).otherwise(F.lit(0)).cast("long")
    x = x.withColumn("__base", first).withColumn("__rest", F.col(seats) - F.sum("__base").over(w))
    most = F.when(F.col(weight) > 0, F.ceil(F.col(weight) * F.col("__n") / F.col("__w")) + 1).otherwise(F.lit(0)).cast("long")
    # One candidate seat a row; k = -1 keeps the row itself.
    c = x.withColumn("__k", F.explode(F.sequence(F.lit(-1).cast("long"), most - 1)))
    rank = Window.partitionBy(*by).orderBy((F.col("__k") < 0).asc(), (F.col(weight) / (2 * (F.col("__base") + F.col("__k")) + 1)).desc(), *order, F.col("__k"))
    c = c.withColumn("__won", ((F.col("__k") >= 0) & (F.row_number().over(rank) <= F.col("__rest"))).cast("long"))
    keys = [k for k in rows.columns]
    return c.groupBy(*keys, "__base").agg((F.col("__base") + F.sum("__won")).alias("quota")).select(*keys, "quota")


def deal_words(rows: DataFrame, most: int, block_words: int, order: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``words``: their group's ``want`` words, dealt in blocks by highest quotients on the words ``held``, no more than ``most``
    times those. What is left of ``want``, a part of a block and what full rows couldn't take, goes to the first ones that have room."""
    x = apportion(rows.withColumn("__seats", F.expr(f"want div {block_words}L")), "held", "__seats", order, by)
    x = x.withColumn("words", F.least(F.col("quota") * F.lit(block_words), (F.col("held") * most).cast("long")))
    x = x.withColumn("__room", (F.col("held") * most).cast("long") - F.col("words"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__room").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least("__room", F.col("want") - F.sum("words").over(w) - before))
    return x.withColumn("__more", more).select(*rows.columns, (F.col("words") + F.col("__more")).alias("words"))


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: float, share: float) -> DataFrame:
    """``sources(source, source_size)`` with ``sid``, ``weight`` and ``target``: ``share`` of all words by weight, no more than
    ``most`` times a source's size; the excess goes to the others by weight (the level at which the caps stop)."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    x = sources.withColumn("sid", F.row_number().over(everything))
    x = x.withColumn("weight", F.element_at(F.array(*[F.lit(float(v)) for v in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("sid"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    x = x.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    x = x.withColumn("open", F.col("cap") > F.col("weight") * F.col("level"))
    x = x.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))).over(whole)["level"])
    return x.withColumn("target", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("cap"))).select("source", "sid", "source_size", "target")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, share: float = 1.0, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ``size`` (words), ``source``, ``source_size``, ``target`` (the source's) and ``taken`` (words).

    Sources get the corpus's words by Sainte-Lague on their targets, so each meets its own to the word; groups of shards get blocks of
    ``block_words`` words by Sainte-Lague on the words they hold, shards their group's, and what is left of a block is dealt in words. In each
    shard, documents stand in a seeded order; a quota of w out of t words takes all of them w // t times and then blocks in a seeded
    order until w % t words are reached, the last one in part. So a document is taken at most ``most`` times and a long one
    may be taken in part. A source has as many shards as its words fill, so a large one is many tasks. Weights go to the sources by
    code point, null last, repeating. A null or empty text has size 0 and is never taken. Repeated rows are documents of their own: those of equal
    id, source and size are counted before they are shuffled, and dealt to shards as numbered copies, so reruns agree.
    ``row_col``, a key of the row, is passed on; with it, texts tell rows of equal id and size apart, then that key.
    """
    row = ["__row"] if row_col else []
    told = [F.xxhash64(F.col(f"`{text_col}`")).alias("copy"), F.lit(1).cast("long").alias("n")] if row_col else []
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), *[F.col(f"`{row_col}`").alias(r) for r in row], *told)
    counted = materialize(d if row_col else d.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    if row_col:
        d = counted.drop("n")
    else:
        several = counted.where(F.col("n") > COPIES).withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)"))).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        each = counted.where(F.col("n") <= COPIES).withColumn("from", F.lit(0).cast("long")).unionByName(several)
        d = each.withColumn("copy", F.explode(F.expr(f"sequence(from, least(from + {COPIES}L, n) - 1)"))).drop("n", "from")
    d = d.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string"))))
    sizes = materialize(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), "sources")
    total, n_sources = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    sources = source_targets(sizes, weights, most, share)
    sources = apportion(sources.withColumn("seats", F.lit(round(total * share)).cast("long")).withColumn("all", F.lit(0)), "target", "seats", ["sid"], ["all"])
    sources = materialize(sources.select("source", "sid", "source_size", "target", F.least("quota", F.col("source_size") * F.lit(most)).alias("want")), "quotas")
    few = F.broadcast(sources) if n_sources <= SMALL else sources
    d = d.join(few.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    shards = F.expr(f"greatest(1L, (source_size + {shard_words - 1}L) div {shard_words}L)")
    x = d.where("size > 0").withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), shards))
    # Partial sums by source and shard first, so that no source is one group.
    held = x.groupBy("sid", "shard").agg(F.sum("size").cast("double").alias("held"), F.first("want").alias("want"))
    held = materialize(held.withColumn("group", F.expr(f"shard div {GROUP}")), "held")
    groups = deal_words(held.groupBy("sid", "group").agg(F.sum("held").alias("held"), F.first("want").alias("want")), most, block_words, ["group"], ["sid"])
    part = held.drop("want").join(groups.select("sid", "group", F.col("words").alias("want")), ["sid", "group"])
    part = deal_words(part, most, block_words, ["shard"], ["sid", "group"])
    # Block i of a shard's t words begins at i * block_words; the last of its n may be short, so blocks that come after it in the seeded order begin earlier.
    n = F.expr(f"(cast(held as long) + {block_words - 1}L) div {block_words}L")
    part = part.select(F.col("sid").alias("__i"), F.col("shard").alias("__j"), F.col("held").cast("long").alias("t"), n.alias("n"), "words")
    place = lambda b: f"pmod({b} * {STRIDE}L + sid * 7919L + shard + {seed}L, n)"
    part = part.withColumn("last", F.expr(place("(n - 1)").replace("sid", "__i").replace("shard", "__j")))
    at = Window.partitionBy("sid", "shard").orderBy("h", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("end", F.sum("size").over(at)).withColumn("begin", F.col("end") - F.col("size"))
    x = x.join(F.broadcast(part) if total // shard_words + n_sources <= SMALL else part, (F.col("sid") == F.col("__i")) & (F.col("shard") == F.col("__j")))
    first = f"words % t - {place('b')} * {block_words}L + CASE WHEN {place('b')} > last THEN n * {block_words}L - t ELSE 0L END"
    again = F.expr(f"""
        CASE WHEN words % t > 0 THEN aggregate(sequence(begin div {block_words}L, (end - 1) div {block_words}L), 0L, (a, b) ->
            a + greatest(0L, least(end, b * {block_words}L + least({block_words}L, {first})) - greatest(begin, b * {block_words}L))) ELSE 0L END""")
    taken = (F.col("size") * F.expr("words div t") + again).cast("long")
    out = lambda x, taken: x.select(F.col("doc_id").alias(id_col), "size", "source", "source_size", "target", taken.alias("taken"), *[F.col(r).alias(row_col) for r in row])
    return out(x, taken).unionByName(out(d.where("size = 0"), F.lit(0).cast("long")))
