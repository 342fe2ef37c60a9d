"""A reproducible shuffle: a Feistel permutation of global row numbers gives each row its shard and slot."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import materialize, partitions

ROUNDS = 4


def permute(x: Column, n: int, seed: int) -> Column:
    """Bijection of 0..n-1: a Feistel network over a grid of at least n cells, walked until it falls below n.

    The grid has a x b cells with a = ceil(sqrt(n)), so fewer than a + 1 cells lie outside and a walk rarely takes a second
    step. No walk is longer than the cells outside plus one; over 64 steps (odds below n ** -30) is an error, never a wrong place.
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))

    def once(v: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed), i, F.lit(0), s["r"]), F.lit(a)), F.lit(a))
            return F.struct(left.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(F.lit(seed), i, F.lit(1), left), F.lit(b)), F.lit(b)).alias("r"))

        start = F.struct(F.floor(v / F.lit(b)).cast("long").alias("l"), (v % F.lit(b)).cast("long").alias("r"))
        start = F.struct(F.expr("0L").alias("l"), v.cast("long").alias("r")) if a == 1 else start
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])

    steps = min(max(a * b - n, 0), 64)
    out = once(x)
    if steps:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), out, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("permutation did not settle")).cast("long"))


def global_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` from 0 in the given order, and their count. One range shuffle; no global sort task."""
    parts = partitions(rows.sparkSession)
    marked = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    marked = materialize(marked.withColumn("__part", F.shiftright("__m", 33)).withColumn("__at", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m"), "rows")
    counts = marked.groupBy("__part").count()
    # one row for each partition
    before = counts.select("__part", (F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("__before"))
    n = marked.count()
    numbered = marked.join(before, "__part").withColumn("row_number", F.col("__before") + F.col("__at"))
    return numbered.drop("__part", "__at", "__before"), n


def assign_shards(docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number`` for each row.

    Rows are numbered by (id, checksum, size); the permutation of that number is the row's place in the shuffle, place mod
    ``shards`` its shard and place div ``shards`` its slot, so counts differ by one at most (law ``rows``). ``size`` is the
    text's UTF-8 bytes plus 8, ``grown_shard`` null. Null ids come first, null texts count as empty, rows that repeat each
    get a place of their own, an empty table gives no rows. ``carry`` names further columns to take along, as ``write_shards`` needs.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *[F.col(c) for c in carry])
    numbered, n = global_rows(rows, ["doc_id", "text_crc32", "size"])
    place = permute(F.col("row_number"), max(n, 1), seed)
    placed = numbered.withColumn("__place", place)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("__place") % shards).cast("int").alias("shard"), F.floor(F.col("__place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number", *carry,
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder of Parquet for each shard, rows in the order of their slots; shards are of equal counts, so no task is large."""
    shards = 1 + (assigned.agg(F.max("shard")).first()[0] or 0)
    assigned.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
