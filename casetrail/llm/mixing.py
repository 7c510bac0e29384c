"""Mixing sources to target weights, with DataFrame operations only.

The words of a source are packed, text after text, into blocks of ``block`` words. Output shards have ``slots`` slots of
one block each. A source has a quota of slots: its blocks times its target over its words, so that a source at twice its
words gets two passes over its blocks, however few. For every shard the number of slots per source is drawn: the whole
part of its expectation, and a multinomial draw over the fractions for the rest, so that large shards stay close to the
weights; what the draws give beyond a quota goes back to the sources they left short. The slots of a source are numbered
through all shards; pass ``j div K`` of ``K`` blocks maps slot ``j`` through a pseudorandom permutation
of 0..K-1 (a swap-or-not shuffle, a bijection for every K), and slots and blocks join by index.

Targets: the weights 5, 2, 1 repeat over the sources in code-point order (null last); sources share ``share`` times
all words by weight, no source gets more than ``repeat`` times its words, and what is above is shared again.
Everything is a function of the rows and the seed, so reruns and retried tasks agree.

A source may hold any part of the rows: positions are prefix sums in two steps (buckets, then rows within buckets), and
slots and blocks are spread over their index. Null texts, and texts without words, have size 0 and nothing is taken of
them; null ids order first; repeated rows are placed one after another; an empty table mixes to an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casetrail.functions.once import computed_once

from .common import prefix_sums, shuffle_partitions, written

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 128
SLOTS = 1024
SHARE = 1.5
REPEAT = 2
WEIGHTS = (5, 2, 1)
SEED = 20_240_607
ROUNDS = 16
BUCKET_ROWS = 50_000
PRIME = 2_147_483_647
OTHER_PRIME = 2_147_483_629


def mixed_hash(*parts: Column | int) -> Column:
    """A small arithmetic hash below ``OTHER_PRIME`` that any SQL engine reproduces; each part is used once."""
    state = F.lit(SEED).cast("long")
    for part in parts:
        part = F.lit(part).cast("long") if isinstance(part, int) else part
        state = (state * 48_271 + (part % PRIME) * 69_621 + 12_345) % PRIME
    return (state * 16_807 + 1) % OTHER_PRIME


def permuted(x: Column, size: Column, *key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0..size-1."""
    def step(at: Column, i: Column) -> Column:
        other = F.array((mixed_hash(*key, i) % size - at + size) % size)
        return F.transform(other, lambda o: F.when(
            mixed_hash(*key, i, F.greatest(at, o)) % 2 == 1, o).otherwise(at))[0]

    rounds = F.sequence(F.lit(1).cast("long"), F.lit(ROUNDS).cast("long"))
    return F.aggregate(rounds, x, step)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, text_hash) of every row, without the text."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_col).alias("text_hash"))


def source_targets(rows: DataFrame, share: float = SHARE, repeat: int = REPEAT,
                   weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: sid, source, source_size, weight and target (one small frame, whatever the rows)."""
    everything = Window.partitionBy(F.lit(0))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    s = (rows.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("sid", (F.row_number().over(order) - 1).cast("long"))
         .withColumn("weight", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * repeat))
    # the level of the water: sources fill up in order of cap / weight, the first that stays below sets it
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everything) * share
    left = wanted - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / open_weight).withColumn("step", F.row_number().over(filling))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("step", "level"))
    s = s.withColumn("reached", F.min(fits).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("reached") * F.col("weight"), F.col("cap")))
    return s.select("sid", "source", "source_size", "weight", target.alias("target"))


def shard_counts(sources: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """(shard, sid, n, first, blocks, quota): drawn slots of a source in a shard, the number of its first one there, and
    the slots of the source in all: as many passes over its blocks, and parts of one, as its target is of its words."""
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    s = (sources.where("source_size > 0")
         .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
         .withColumn("quota", F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5))
         .withColumn("all_slots", F.sum("quota").over(everything)).where("all_slots > 0"))
    sizes = {"full": F.lit(slots).cast("long"), "last": F.col("all_slots") % slots}
    s = s.select("*", *(n.alias(f"{k}_n") for k, n in sizes.items()))
    s = s.select("*", *(F.expr(f"quota * {k}_n div all_slots").alias(f"{k}_base") for k in sizes),
                 *(F.expr(f"quota * {k}_n % all_slots").alias(f"{k}_odd") for k in sizes))
    s = s.select("*", *((F.col(f"{k}_n") - F.sum(f"{k}_base").over(everything)).alias(f"{k}_rest") for k in sizes),
                 *(F.sum(f"{k}_odd").over(everything).alias(f"{k}_odds") for k in sizes),
                 *(F.coalesce(F.sum(f"{k}_odd").over(before), F.lit(0)).alias(f"{k}_from") for k in sizes))
    s = written(s, "mix-draws")
    last = F.col("shard") == F.floor(F.col("all_slots") / slots)
    s = s.withColumn("shard", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("all_slots") - 1) / slots))))
    pick = {k: F.when(last, F.col(f"last_{k}")).otherwise(F.col(f"full_{k}"))
            for k in ("base", "odd", "rest", "from", "odds")}
    s = s.select("shard", "sid", "blocks", "quota", *(c.alias(k) for k, c in pick.items()))

    def drawn(i: Column) -> Column:
        u = mixed_hash(F.col("shard"), i) / F.lit(float(OTHER_PRIME)) * F.col("odds")
        return (u >= F.col("from")) & (u < F.col("from") + F.col("odd"))

    draws = F.when(F.col("rest") > 0, F.size(F.filter(F.sequence(
        F.lit(1).cast("long"), F.greatest(F.col("rest"), F.lit(1))), drawn))).otherwise(0)
    s = s.select("shard", "sid", "blocks", "quota", (F.col("base") + draws).alias("n"),
                 F.floor(F.col("shard") / 1024).alias("bucket"))
    return prefix_sums(s, ["shard"], "n", "first").drop("bucket")


def slot_blocks(counts: DataFrame) -> DataFrame:
    """(shard, slot, sid, block): the block that fills each slot.

    Slots that the draw gives a source beyond its quota go, in order, to the sources that it left short.
    """
    counts = written(counts.withColumn("over", F.greatest(F.lit(0).cast("long"), F.least(
        F.col("n"), F.col("first") + F.col("n") - F.col("quota")))), "mix-counts")
    # few rows become many: the partitions are asked for by number, so that they are not merged beforehand
    s = counts.where("n > over").repartition(shuffle_partitions(counts.sparkSession), "shard", "sid").withColumn(
        "i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - F.col("over"))))
    own = s.select("shard", F.col("i").alias("slot"), "sid", "blocks", (F.col("first") + F.col("i") - 1).alias("j"))
    freed = prefix_sums(counts.where("over > 0").select(
        "shard", "sid", "n", "over", F.lit(0).alias("all"), F.floor(F.col("shard") / 1024).alias("bucket")),
        ["shard", "sid"], "over", "base", "all")
    freed = freed.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("over")))).select(
        "shard", (F.col("n") - F.col("over") + F.col("i")).alias("slot"), F.col("sid").alias("of"),
        (F.col("base") + F.col("i")).alias("f"))
    short = counts.groupBy("sid", "blocks", "quota").agg(F.sum("n").alias("got")).where("got < quota")
    before = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("base", F.coalesce(F.sum(F.col("quota") - F.col("got")).over(before), F.lit(0))).withColumn(
        "i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota") - F.col("got")))).select(
        "sid", "blocks", (F.col("got") + F.col("i") - 1).alias("j"), (F.col("base") + F.col("i")).alias("f"))
    given = freed.join(short, "f").select("shard", F.struct("of", "slot").alias("at"), "sid", "blocks", "j")
    s = own.select("shard", F.struct(F.col("sid").alias("of"), "slot").alias("at"), "sid", "blocks", "j").unionByName(given)
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("sid"), F.floor(F.col("j") / F.col("blocks")))
    return s.select("shard", F.col("at.slot").alias("slot"), F.col("at.of").alias("drawn_for"), "sid", block.alias("block"))


def placed(rows: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Rows with sid and start: the place of their first word among the words of their source."""
    key = [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name")]
    sids = sources.select(*key, "sid", "source_size", "target")
    rows = (rows.select("*", *key).join(sids, ["_none", "_name"]).drop("_none", "_name")
            .withColumn("bucket", F.pmod(F.coalesce("id", F.lit(0)), F.lit(buckets))))
    return prefix_sums(rows, ["id", "size", "text_hash"], "size", "start").drop("bucket")


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed rows, filled slots, and pieces: (sid, start, from, length, uses) of every row with words, by block."""
    rows = written(sized(docs, id_col, text_col, source_col), "mix-rows")
    sources = written(source_targets(rows), "mix-sources")
    at = placed(rows, sources, rows.count() // BUCKET_ROWS + 1)
    filled = slot_blocks(shard_counts(sources, block, slots))
    uses = filled.groupBy("sid", "block").agg(F.count("*").alias("uses"))
    b, end = F.lit(block).cast("long"), F.col("start") + F.col("size")
    cut = (at.where("size > 0")
           .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))))
           .withColumn("from", F.greatest(F.col("start"), F.col("block") * b) - F.col("start"))
           .withColumn("length", F.least(end, (F.col("block") + 1) * b) - F.col("start") - F.col("from")))
    pieces = cut.join(uses, ["sid", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return at, filled, pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row."""
    at, _, pieces = mix(docs, **options)
    keep = ["id", "source", "size", "source_size", "target"]
    some = pieces.groupBy("sid", "start", *keep).agg(F.sum(F.col("length") * F.col("uses")).alias("taken"))
    none = at.where("size = 0").select(*keep, F.lit(0).cast("long").alias("taken"))
    return some.select(*keep, "taken").unionByName(none)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    count_col: str = "n_chars", **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: a row holds what one pass takes of a text, so a text that is taken
    twice gives two rows with its id. A text taken whole stays as it is, else its words are joined by spaces. Rows that
    agree in id and text are taken like the first of them.
    """
    _, _, pieces = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    piece = F.struct(F.col("from"), F.col("length"), F.col("uses"))
    shares = (pieces.groupBy("id", "text_hash", "sid", "start").agg(F.sort_array(F.collect_list(piece)).alias("_pieces"))
              .groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
              .agg(F.min_by("_pieces", "start").alias("_pieces")))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("hash")).join(
        shares, F.col(f"row.`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    most, text = F.array_max(F.transform("_pieces", lambda p: p["uses"])), F.col(f"row.`{text_col}`")
    rows = rows.where(most > 0)
    uneven = F.exists("_pieces", lambda p: p["uses"] < most)
    # split once: a lambda over pieces would otherwise split the text again for every piece
    rows = computed_once(rows, words=F.when(uneven, F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), most)))
    whole = F.forall("_pieces", lambda p: p["uses"] >= F.col("pass"))
    own = F.filter("_pieces", lambda p: p["uses"] >= F.col("pass"))
    words = F.transform(own, lambda p: F.array_join(F.slice(
        F.col("words"), (p["from"] + 1).cast("int"), p["length"].cast("int")), " "))
    rows = rows.withColumn("text", F.when(whole, text).otherwise(F.array_join(words, " ")))
    kinds = {f.name: f.dataType for f in docs.schema}
    new = {text_col: F.col("text"), count_col: F.length("text").cast(kinds.get(count_col, "long"))}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
