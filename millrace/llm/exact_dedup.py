"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of BLOCK bytes. The distinct blocks are sorted and numbered:
the number is a block's name. Adjacent names are paired and the distinct pairs named in the same
way until each document has one name; (round, name) then is its identity, and equal identities
mean equal texts, without any chance of a collision. Contents are shuffled once, as distinct
blocks combined before the shuffle; a row finds its block's name by a 64-bit hash, and blocks
whose hash is that of another block by their content. All of it is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.staging import discard, release, stage

BLOCK = 4096
#: Up to so many hashes that several blocks share are named in the plan; beyond, every row keeps its blocks until they are named.
LISTED = 10_000
NO_PARTNER = -(1 << 63)


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space; null as the empty text. Single spaces are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _blocks(raw: Column, size: int) -> Column:
    """The blocks of a binary column; an empty one is one empty block."""
    last = F.greatest(F.ceil(F.length(raw) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _named(rows: DataFrame, *order: str) -> DataFrame:
    """The distinct rows, sorted, with their number as ``name``."""
    return rows.distinct().sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identified(docs: DataFrame, keep: list[str], block: int = BLOCK, bits: int = 64) -> DataFrame:
    """Staged (rid, row, doc_id, text_sha256, level, name) of every row of docs; row is the struct of the columns to keep.

    bits: of the hash by which rows find their names; fewer make collisions, which change no result.
    """
    found = lambda b: F.shiftrightunsigned(F.xxhash64(b), 64 - bits) if bits < 64 else F.xxhash64(b)
    # a column of its own, so that the text is normalised once a row and not once a block
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id"), F.encode(normalised(F.col("text")), "UTF-8").alias("_raw"))
    raw = F.col("_raw")
    content = texts.select(F.explode(_blocks(raw, block)).alias("block")).select(found(F.col("block")).alias("h"), "block")
    names = stage(_named(content, "h", "block").select("h", "name"), "block_names")
    shared = [r["h"] for r in names.groupBy("h").count().where("count > 1").select("h").limit(LISTED + 1).collect()]
    clash = (lambda h: F.lit(True)) if len(shared) > LISTED else (lambda h: h.isin(shared)) if shared else (lambda h: F.lit(False))
    marked = F.transform(_blocks(raw, block), lambda b: F.struct(found(b).alias("h"), F.when(clash(found(b)), b).alias("block")))
    rows = stage(texts.select(F.monotonically_increasing_id().alias("rid"), "row", "doc_id", F.sha2(raw, 256).alias("text_sha256"), marked.alias("blocks")), "identified_rows")
    at = rows.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "b")).select("rid", "n", "pos", "b.h", "b.block")
    if shared:
        by_content = _named(content.where(clash(F.col("h"))), "h", "block").select("h", "block", (-1 - F.col("name")).alias("name"))
        every = names.where(~clash(F.col("h"))).select("h", F.lit(None).cast("binary").alias("block"), "name").union(by_content).select(F.col("h").alias("h_"), F.col("block").alias("block_"), "name")
        level = at.join(every, (F.col("h") == F.col("h_")) & F.col("block").eqNullSafe(F.col("block_")))
    else:
        level = at.join(names, "h")
    level = stage(level.select("rid", "n", "pos", "name"), "names_0")
    discard(docs.sparkSession, names)
    ends, rounds = [], (int(level.agg(F.max("n")).first()[0] or 1) - 1).bit_length()
    for k in range(rounds + 1):
        ends.append(level.where("n = 1").select("rid", F.lit(k).alias("level"), "name"))
        if k == rounds:
            break
        place = F.shiftright("pos", 1)
        pairs = stage(level.where("n > 1").groupBy("rid", place.alias("pos")).agg(
            F.shiftright(F.max("n") + 1, 1).alias("n"), F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_PARTNER)).alias("b")
        ), "pairs")
        names = stage(_named(pairs.select("a", "b"), "a", "b"), "pair_names")
        level = stage(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), f"names_{k + 1}")
        discard(docs.sparkSession, pairs, names)
    identity = ends[0]
    for more in ends[1:]:
        identity = identity.union(more)
    out = stage(rows.drop("blocks").join(identity, "rid"), "identities")
    discard(docs.sparkSession, rows)
    release(docs.sparkSession)
    return out


def _marked(found: DataFrame) -> DataFrame:
    """found with keep_id, group_size and kept."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    groups = found.groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("group_size"))
    return found.join(groups, ["level", "name"]).select("row", "doc_id", "text_sha256", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"))


def duplicate_report(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when they are after each run of blanks is replaced by one space; null counts
    as empty. The row with the smallest doc_id stays, of several with that id the one read first;
    rows without doc_id come last, and keep_id is null where a group has no other. So exactly one
    row of each group is kept. Whole texts of any length count. An empty table gives no rows.
    """
    return _marked(identified(docs, ["doc_id"], block, bits)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """The rows of docs that stay, with their columns, whatever their names."""
    return _marked(identified(docs, docs.columns, block, bits)).where("kept").select(*[f"row.`{c}`" for c in docs.columns])
