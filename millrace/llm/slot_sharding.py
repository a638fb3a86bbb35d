"""Sharding by fixed virtual slots.

A record's hash puts it into one of SLOTS slots for good. Shards own slots by a versioned map;
rebalancing and growth edit the map and never rehash records. The law held here is ``bytes``:
the first map deals slots in turn, and the edited one evens out the bytes that were summed by
slot. What reaches the driver is one row a slot, a fixed number.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.staging import new_path

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each slot. An edit returns the next version."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @classmethod
    def dealt(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, weight: dict[int, int]) -> SlotMap:
        """Move slots from the heaviest to the lightest shard while that narrows the gap between them; itself if none moves."""
        owner, load = list(self.owner), [0] * self.shards
        held: list[dict[int, int]] = [{} for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            if w := weight.get(slot, 0):
                held[shard][slot] = w
                load[shard] += w
        while True:
            high, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[high] - load[low]
            slot = min((s for s, w in held[high].items() if w < gap), key=lambda s: (abs(2 * held[high][s] - gap), s), default=None)
            if slot is None:
                return replace(self, version=self.version + 1, owner=tuple(owner)) if tuple(owner) != self.owner else self
            w = held[high].pop(slot)
            held[low][slot] = w
            load[high], load[low], owner[slot] = load[high] - w, load[low] + w, low

    def grown(self, weight: dict[int, int]) -> SlotMap:
        """One more shard, which takes slots from the heaviest shards until it has its part; no slot moves between old shards."""
        owner, load = list(self.owner), [0] * (self.shards + 1)
        for slot, shard in enumerate(owner):
            load[shard] += weight.get(slot, 0)
        part = sum(load) / (self.shards + 1)
        for slot in sorted(range(len(owner)), key=lambda s: (-weight.get(s, 0), s)):
            w, shard = weight.get(slot, 0), owner[slot]
            if w and load[self.shards] + w <= part and load[shard] - w >= part * 0.99:
                owner[slot], load[shard], load[self.shards] = self.shards, load[shard] - w, load[self.shards] + w
        return SlotMap(self.version + 1, self.shards + 1, tuple(owner))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version once; a version that is there already stays, and another map under its number is an error."""
        if self.version in SlotMap.versions(spark, path):
            if SlotMap.load(spark, path, self.version) != self:
                raise ValueError(f"version {self.version} of the slot map is another map")
            return
        rows = [(self.shards, slot, shard) for slot, shard in enumerate(self.owner)]
        spark.createDataFrame(rows, "shards int, slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def versions(cls, spark: SparkSession, path: str) -> list[int]:
        """The versions that are written completely."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        done = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS"))
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in done or [])

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> SlotMap | None:
        """The last version at path, if there is one."""
        return cls.load(spark, path) if cls.versions(spark, path) else None

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        version = version or cls.versions(spark, path)[-1]
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot").collect()  # one row a slot
        return cls(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with the struct ``_sh``: size, text_crc32, law, shard, slot (place in the shard) and virtual_slot.

    Size is the UTF-8 bytes of the text plus 1; a null text has none and counts as 1, its crc is
    that of no bytes. The hash is of doc_id, size and crc, so rows without doc_id spread too;
    repeated rows share a slot. Texts of any length count whole. An empty table gives no rows.
    keep: the columns of docs to carry; ``_sh`` replaces a column of that name. The versions of
    the map are stored at map_path, in the shared folder if none is given; a map that is stored
    there is loaded and edited, and where no slot moves no version is added.
    """
    keep = [c for c in docs.columns if c != "_sh"] if keep is None else keep
    return sharded(docs, keep, shards, slots, map_path).select(*[f"row.`{c}`" for c in keep], "_sh")


def sharded(docs: DataFrame, keep: list[str], shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """The struct ``row`` of the columns to keep, and ``_sh``."""
    spark = docs.sparkSession
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    record = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").alias("id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    # a record's slot follows from the record, so the rows are read again and not written in between
    record = record.withColumn("virtual_slot", F.pmod(F.xxhash64("id", "size", "crc"), F.lit(slots)).cast("int"))
    sums = {r["virtual_slot"]: (r["bytes"], r["n"]) for r in record.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}  # at most one row a slot
    path = map_path or new_path(spark, "slot_map")
    stored = SlotMap.stored(spark, path)
    if stored and (stored.shards, len(stored.owner)) != (shards, slots):
        raise ValueError(f"the stored map has {stored.shards} shards and {len(stored.owner)} slots")
    before_edit = stored or SlotMap.dealt(shards, slots)
    chosen = before_edit.rebalanced({s: b for s, (b, _) in sums.items()})
    if not stored:
        before_edit.save(spark, path)
    if chosen != before_edit:
        chosen.save(spark, path)
    before, rows = [0] * shards, []
    for slot in sorted(sums):
        owner = chosen.owner[slot]
        rows.append((slot, owner, before[owner]))
        before[owner] += sums[slot][1]
    places = spark.createDataFrame(rows, "virtual_slot int, shard int, before long")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "crc", "size")) - 1
    return record.withColumn("within", within).join(F.broadcast(places), "virtual_slot").select(
        "row", F.struct("size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "virtual_slot").alias("_sh")
    )


def shard_report(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under the law of bytes)."""
    out = shard(docs, shards, keep=["doc_id"])
    return out.select("doc_id", *[f"_sh.{c}" for c in ("size", "text_crc32", "law", "shard", "slot")], F.lit(None).cast("int").alias("grown_shard"), "_sh.virtual_slot")
