"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's shard depends on the key and the number of shards alone, without a table of the
ring; when a shard is appended, about 1/(n+1) of the keys move, all of them into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark_io import absent, small_or_not, table, written

# Fixed value: the multiplier of the linear congruential generator of the published algorithm.
MULTIPLIER = 2862933555777941757
_WRAP = "cast(18446744073709551616 as decimal(20,0))"


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a non-null long key.

    The generator's 64-bit products are exact in decimal(38, 0); each step leaps to the next
    shard count at which the key would move, until that is ``shards`` or more.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    seed = F.when(key < 0, key.cast("decimal(20,0)") + F.expr(_WRAP)).otherwise(key.cast("decimal(20,0)")).cast("decimal(20,0)")
    start = F.struct(seed.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % F.expr(_WRAP)).cast("decimal(20,0)")
        high = F.floor(k / F.lit(1 << 33).cast("decimal(20,0)")).cast("double")
        leap = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1.0))).cast("long")
        return F.when(s["j"] < shards, F.struct(k.alias("k"), s["j"].alias("b"), leap.alias("j"))).otherwise(s)

    # the first step always leaps from -1; each later one gains a shard at least
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, lambda s: s["b"].cast("int"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``shard`` and ``grown_shard`` (with one more shard) depend on the id and the count of shards
    alone; rows with equal ids go together, and a null id counts as the id 0.  ``slot`` numbers
    a shard's rows from 0 without gaps, in the order of id (null first), checksum and size; equal
    rows are numbered in any order.  ``size`` is the text's UTF-8 bytes plus 1; a null text counts
    as empty.  Other columns are ignored.
    """
    key, row, place, part = absent(docs, "key", "row", "place", "part")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias(key),
    )
    placed = written(rows.select(id_col, "size", "text_crc32", jump_hash(F.col(key), shards).alias("shard"), jump_hash(F.col(key), shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias(row)))
    # ranges of rows; the row's number parts equal ones, so no range need hold them all
    order = ["shard", id_col, "text_crc32", "size", row]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.select(*[c for c in placed.columns if c != row], F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place)))
    # a row per range and shard within it: as many as ranges and shards, and few rows more
    pieces = ranged.groupBy("shard", part).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("shard", part, "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return ranged.join(small_or_not(written(offsets)), ["shard", part]).select(
        id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col(place) - F.col("first")).cast("long").alias("slot"), "grown_shard"
    )


def op4_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    """The checksum's table, by its rule: eight halvings of each byte by the reversed polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


ORACLE_SQL = f"""
WITH RECURSIVE k AS (SELECT DISTINCT coalesce(doc_id, 0) AS key FROM documents),
s AS (SELECT key, shards, CAST(key AS HUGEINT) + CASE WHEN key < 0 THEN 18446744073709551616 ELSE 0 END AS r, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j
      FROM k, (SELECT unnest([8, 9]) AS shards)
      UNION ALL
      SELECT key, shards, r, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST(r // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
      FROM (SELECT key, shards, (r * {MULTIPLIER} + 1) % 18446744073709551616 AS r, j FROM s WHERE j < shards)),
p AS (SELECT key, CAST(max(b) FILTER (shards = 8) AS INT) AS shard, CAST(max(b) FILTER (shards = 9) AS INT) AS grown_shard FROM s WHERE j >= shards GROUP BY key),
h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, n + 1 AS size,
             xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, n), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
                 lambda a, y: xor(a >> 8, {_crc_table()}[1 + (xor(a, y) & 255)]))) AS text_crc32 FROM h)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM c JOIN p ON p.key = coalesce(c.doc_id, 0)
"""
