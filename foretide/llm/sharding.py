"""Sharding by sampled splitters: records in key order are cut into shards of near equal bytes.

Equal texts are a group.  A group of up to a 1/`fine` of a shard lies in one shard; larger ones (at most
`fine` times as many as shards) are cut at the borders.  Keys: (hash of the text, hash of the id, tie).
A size-weighted sample of keys gives quantile boundaries of fine ranges, records are range-partitioned
and ranges measured exactly; a range that holds over twice its share of bytes is subdivided by
splitters drawn from it alone, until none is overfull or one key is all of it.  Every range that
crosses a shard's border is cut at the record where the running bytes do.

The number of ranges grows with the bytes (`range_bytes` each, 64 at least); the sample is a few keys
for each range, drawn by a threshold on exponential clocks, so no partition sends more than its part.

Defined cases: a null text has size 1 and crc 0; repeated rows are placed one by one; an empty
table gives no rows; with fewer records than shards some shards are empty.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import table, text_of


KEY = ("k1", "k2", "k3")


def splitters(keyed: DataFrame, ranges: int, total: int, each: int = 16) -> list[tuple]:
    """Boundaries of `ranges` ranges: quantiles of about each * ranges keys, drawn with chances in
    proportion to size (their exponential clocks stop before the threshold)."""
    uniform = (F.pmod(F.xxhash64(F.lit(11), *KEY), F.lit(1 << 40)) + 1) / float((1 << 40) + 2)
    stop = each * ranges / max(total, 1)
    drawn = keyed.filter(-F.log(uniform) / F.col("size") <= stop).select(*KEY)
    keys = sorted(tuple(r) for r in drawn.collect())  # about each * ranges keys
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def ranged(keyed: DataFrame, range_bytes: int, total: int) -> DataFrame:
    """keyed with its range: 0 to the number of boundaries, in the order of keys."""
    ranges = max(64, -(-total // range_bytes))
    bounds = splitters(keyed, ranges, total)
    while True:
        found = _place(keyed, bounds)
        size = {r["range"]: (r.bytes, r.many) for r in found.groupBy("range").agg(F.sum("size").alias("bytes"), (F.min(F.struct(*KEY)) != F.max(F.struct(*KEY))).alias("many")).collect()}  # one row a range
        over = [r for r, (n, many) in size.items() if many and n > 2 * total / ranges]
        own = found.filter(F.col("range").isin(over)) if over else None
        more = set(splitters(own, sum(-(-size[r][0] * ranges // total) for r in over), sum(size[r][0] for r in over))) - set(bounds) if over else ()
        if not more:
            return found
        bounds = sorted({*bounds, *more})


def _place(keyed: DataFrame, bounds: list[tuple]) -> DataFrame:
    """A binary search over the boundaries, as nested comparisons for the first 256 and a join with the
    boundaries of each coarse range for the rest: expressions stay small, whatever their number."""
    coarse = bounds[:: max(1, -(-len(bounds) // 256))]
    key = F.struct(*KEY)

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        at = F.struct(*(F.lit(int(x)).cast("long").alias(n) for x, n in zip(coarse[mid], KEY)))
        return F.when(key < at, search(lo, mid)).otherwise(search(mid + 1, hi))

    spark = keyed.sparkSession
    rows, at = [], 0
    for i in range(len(coarse) + 1):
        inside = [b for b in bounds[at:] if i == len(coarse) or b < coarse[i]]
        rows.append((i, at, [tuple(map(int, b)) for b in inside]))
        at += len(inside)
    inner = spark.createDataFrame(rows, "coarse int, base int, inner array<struct<k1:long,k2:long,k3:long>>")  # the boundaries
    found = keyed.withColumn("coarse", search(0, len(coarse))).join(F.broadcast(inner), "coarse")
    place = (F.col("base") + F.size(F.filter("inner", lambda b: b <= key))).cast("int")
    return found.withColumn("range", place).drop("coarse", "base", "inner")


def shard_by_bytes(docs: DataFrame, shards: int = 8, range_bytes: int = 64 << 20, fine: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot for every record.

    Each shard's bytes differ from total / shards by less than its largest record or whole group."""
    text = text_of(F.col(text_col))
    keyed = docs.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(3), F.col(id_col)).alias("k2"), F.monotonically_increasing_id().alias("k3"),
    )
    keyed = table(keyed, "shard-keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    groups = keyed.groupBy("k1").agg(F.sum("size").alias("group"), F.count(F.lit(1)).alias("n"))  # combines before the shuffle
    # Groups too large for one shard: at most fine * shards of them, whose records go by their own keys.
    large = [r.k1 for r in groups.filter((F.col("n") > 1) & (F.col("group") > total / (shards * fine))).select("k1").collect()]
    alone = F.col("k1").isin(large) if large else F.lit(False)
    keyed = keyed.withColumn("alone", alone).withColumn("k2", F.when(F.col("alone"), F.col("k2")).otherwise(F.lit(0))).withColumn("k3", F.when(F.col("alone"), F.col("k3")).otherwise(F.lit(0))).withColumn("tie", F.xxhash64(F.lit(5), F.col(id_col)))
    placed = table(ranged(keyed, range_bytes, total), "shard-ranges")
    # The exact bytes of each range fix where it starts among all bytes; there is one row a range.
    starts = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("range", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("from"), F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("row0"))
    inside = Window.partitionBy("range").orderBy(*KEY, "tie", F.col(id_col))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    # A record's place is the middle of what goes together: the record itself, or its group.
    together = Window.partitionBy("range", *KEY)
    end = F.max("_upto").over(together)
    out = placed.withColumn("_upto", F.sum("size").over(running)).withColumn("_row", F.row_number().over(inside))
    out = out.withColumn("_bytes", F.sum("size").over(together)).withColumn("_end", end).join(F.broadcast(starts), "range")
    middle = 2 * (F.col("from") + F.col("_end")) - F.col("_bytes")
    out = out.select(F.col(id_col), "size", "text_crc32", F.least(F.floor(middle * shards / (2 * total)), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("row0") + F.col("_row") - 1).alias("row")) if total else out.select(F.col(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("row"))
    out = table(out, "shard-placed")
    first = out.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return out.join(F.broadcast(first), "shard").select(F.col(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the records under shard=N/ in slot order.  Ids must be unique."""
    out = docs.join(placed.select(id_col, "shard", "slot"), id_col)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
