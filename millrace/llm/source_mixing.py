"""Mixing sources to target weights by Sainte-Lague apportionment (native expressions only).

1. Sources in code-point order get the weights 3, 1, 2, repeating. They share ``share`` of all
   words by weight; a target stops at ``max_epochs`` times its source and the excess goes to
   the others (water filling, solved in closed form over the source table).
2. The mix is cut into about BLOCKS blocks of equal word counts. The quotients
   target / (2 k + 1) rank the blocks; the highest of them, one a block, are the seats. A shard
   is a run of consecutive ranks, so every shard has an integer quota of each source.
3. A source's documents stand in seeded order as one stream of words cut into blocks. The shards
   draw their quotas one after the other from the seeded order of the blocks, which starts again
   when all are drawn. The last draw is in part and makes good what the target is above or below
   the seats, so a source smaller than a block gets its target like any other.

A hot source is spread over 4096 ranges of the seeded order; only sums per range meet, so no
task gets a source whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.staging import stage

SEED = "mix-1"
BLOCKS = 1 << 16
SHARE, MAX_EPOCHS = 1.5, 2
SHARDS = 64
#: Weights by the place of a source in code-point order.
WEIGHTS = (3, 1, 2)
DIGITS = 3  # hex digits of the range: 4096 ranges


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; a null text has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, place, weight, target) from (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("place") - 1) % len(WEIGHTS) + 1).cast("int")))
    weighed = weighed.withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    # The level is that of the first source, by cap / weight, that the others' share does not fill.
    everything = Window.partitionBy()
    by_need = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "place")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    return levels.withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("place")))).over(everything)).select(
        "source", "source_size", "place", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target")
    )


def apportion(targets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(place, shard, seats) from targets with a block size: Sainte-Lague seats by rank, in shards of equal length.

    At most BLOCKS plus three a source of quotients are ranked, a bound that the corpus does not move.
    """
    seats = F.round(F.sum("target").over(Window.partitionBy()) / F.col("block"))
    most = (F.floor(F.col("target") / F.col("block")) + 2).cast("long")
    quotients = targets.where("target > 0").withColumn("seats", seats).withColumn("most", most).select("place", "seats", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("k"), "target")
    ranked = quotients.withColumn("rank", F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "place", "k")) - 1)
    return ranked.where(F.col("rank") < F.col("seats")).groupBy("place", F.floor(F.col("rank") * shards / F.col("seats")).cast("int").alias("shard")).agg(F.count("*").alias("seats"))


def blocks_of(targets: DataFrame) -> DataFrame:
    """(place, b, length): the blocks of each source's stream, at most blocks / share and one a source."""
    n = F.ceil(F.col("source_size") / F.col("block")).cast("long")
    each = targets.where("source_size > 0").select("place", "block", "source_size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("b"))
    return each.select("place", "b", F.least("block", F.col("source_size") - F.col("b") * F.col("block")).alias("length"))


def draw_blocks(targets: DataFrame, seed: str = SEED, shards: int = SHARDS) -> DataFrame:
    """(place, b, turn, shard, words): the draws of each source's blocks, from targets with a block size.

    The quotas of apportion() deal the turns of a source to the shards, so a shard has as many
    draws of it as its quota says. The words of all draws are the rounded target: the last is in
    part, and where seats are too few for the target, the last shard of the source draws on. A
    source without a seat is drawn by shard 0.
    """
    seats = apportion(targets, shards).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("shard", "seats"))).alias("quota"))
    ends = F.transform("quota", lambda _, k: F.aggregate(F.slice("quota", F.lit(1), k + 1), F.lit(0).cast("long"), lambda n, q: n + q["seats"]))
    seats = seats.select("place", F.col("quota.shard").alias("takers"), ends.alias("ends"))
    order = Window.partitionBy("place").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("place"), F.col("b"))), "b")
    wanted = targets.select("place", "source_size", F.round("target").cast("long").alias("wanted"))
    each = blocks_of(targets).withColumn("lot", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.count("*").over(Window.partitionBy("place")))
    turns = each.join(wanted, "place").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("wanted") / F.col("source_size")))))
    turns = turns.withColumn("words", F.least("length", F.col("wanted") - F.col("pass") * F.col("source_size") - F.col("before"))).where("words > 0").withColumn("turn", F.col("pass") * F.col("n") + F.col("lot"))
    at = F.least(F.size(F.filter("ends", lambda e: e <= F.col("turn"))), F.size("takers") - 1)
    return turns.join(seats, "place", "left").select("place", "b", "turn", F.coalesce(F.get("takers", at), F.lit(0)).alias("shard"), "words")


def mix(docs: DataFrame, seed: str = SEED, share: float = SHARE, max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS, keep: list[str] | None = None) -> DataFrame:
    """docs with the struct ``_mx``: size, source_size, target and taken words of each row, and the shards that draw the block it starts in.

    A null text has size 0 and takes 0. A null source is a source of its own, the last. Rows
    without doc_id and repeated rows are documents like others; which of equal rows is taken first
    does not matter, as they are equal. A text of any length counts as a whole and may lie in many
    blocks. An empty table gives no rows; if no document has words all targets are 0. keep: the
    columns of docs to carry; ``_mx`` replaces a column of that name.
    """
    keep = [c for c in docs.columns if c != "_mx"] if keep is None else keep
    return _mixed(docs, keep, seed, share, max_epochs, blocks).select(*[f"row.`{c}`" for c in keep], "_mx")


def _mixed(docs: DataFrame, keep: list[str], seed: str = SEED, share: float = SHARE, max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS) -> DataFrame:
    """The struct ``row`` of the columns to keep, and ``_mx``."""
    turn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    # the number of a row is stored with it, so that the decisions can be made on narrow rows
    table = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.monotonically_increasing_id().alias("number"), F.col("source").alias("source"), F.col("doc_id").alias("id"), word_count(F.col("text")).alias("size"), turn.alias("turn"))
    table = stage(table.withColumn("range", F.substring("turn", 1, DIGITS)), "sized")
    sized = table.drop("row")
    by_range = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), share, max_epochs)
    targets = stage(targets.withColumn("block", F.greatest(F.ceil(F.sum("target").over(Window.partitionBy()) / blocks), F.lit(1)).cast("long")), "targets")
    drawn = stage(draw_blocks(targets, seed), "drawn")
    by_block = drawn.groupBy("place", "b").agg(F.sum("words").alias("drawn"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards"))
    ahead = F.coalesce(F.sum("drawn").over(Window.partitionBy("place").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_block = blocks_of(targets).join(by_block, ["place", "b"], "left").na.fill(0, ["drawn"]).withColumn("ahead", ahead)

    starts = by_range.withColumn("start", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.alias("s").join(targets.alias("i"), F.col("s.source").eqNullSafe(F.col("i.source"))).select("s.source", "range", "start", "place", "block", "source_size", "target")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "range").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("inside", inside).alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.range") == F.col("s.range")))
    placed = placed.select("number", "size", "source_size", "target", "place", "block", (F.col("start") + F.col("inside")).alias("from")).withColumn("to", F.col("from") + F.col("size"))

    def upto(column: str) -> Column:
        """Words that the draws take of the stream before a place; a block that is drawn n times in whole and then in part has the part at its start."""
        inside = F.col(column) - F.col(f"{column}_b") * F.col("block")
        length = F.least("block", F.col("source_size") - F.col(f"{column}_b") * F.col("block"))
        whole = F.floor(F.col(f"{column}_drawn") / length)
        return F.col(f"{column}_ahead") + whole * inside + F.least(F.col(f"{column}_drawn") - whole * length, inside)

    for column in ("from", "to"):
        at = F.least(F.floor(F.col(column) / F.col("block")), F.ceil(F.col("source_size") / F.col("block")) - 1).cast("long")
        side = by_block.select(F.col("place").alias("pl"), F.col("b").alias(f"{column}_b"), F.col("drawn").alias(f"{column}_drawn"), F.col("ahead").alias(f"{column}_ahead"), F.col("shards").alias(f"{column}_shards"))
        placed = placed.withColumn("at", at).join(side, (F.col("place") == F.col("pl")) & (F.col("at") == F.col(f"{column}_b")), "left").drop("pl", "at")
    taken = F.when(F.col("size") > 0, upto("to") - upto("from")).otherwise(0).cast("long")
    decided = placed.select("number", F.struct("size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, F.col("from_shards")).alias("shards")).alias("_mx"))
    return table.select("number", "row").join(decided, "number").select("row", "_mx")


def apply_mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it.

    A row whose words are taken in part is rounded up or down by a seeded lot of its own, so the
    sources keep their shares. The columns are those of docs.
    """
    lot = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":lot:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    copies = F.when(F.col("_mx.size") > 0, F.floor(F.col("_mx.taken") / F.col("_mx.size") + lot)).otherwise(0).cast("int")
    taken = _mixed(docs, docs.columns, seed, **options).select("row", copies.alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, and the shards (an array, one for each draw of the block the row starts in)."""
    return mix(docs, keep=["doc_id"], **options).select("doc_id", "_mx.size", "_mx.source_size", "_mx.target", "_mx.taken", "_mx.shards")
