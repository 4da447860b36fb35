"""A first filter by a bit map of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.session import cut_lineage

#: Bits of the map, whatever the number of keys: 257 rows of 4 KB are broadcast.
BITS = 1 << 23


def maybe_in(df: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``wanted.key`` (both bigint): none that is gets lost.

    Of other rows those remain whose bit another key has set: few, as long as the keys
    are few against ``BITS``; with very many keys all rows remain. An exact join follows.
    """
    spot = lambda c: F.pmod(F.coalesce(c, F.lit(0)), F.lit(BITS)) + 1
    maps = (
        wanted.select(spot(F.col("key")).alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("__part"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__bits"))
    )
    marked = df.withColumn("__spot", spot(key)).withColumn("__part", F.bitmap_bucket_number("__spot"))
    place = "CAST(bitmap_bit_position(__spot) AS INT)"
    byte = f"CAST(conv(hex(substring(__bits, {place} DIV 8 + 1, 1)), 16, 10) AS INT)"
    return (
        marked.join(F.broadcast(cut_lineage(maps)), "__part")
        .where(f"({byte} >> ({place} % 8)) & 1 = 1")
        .drop("__spot", "__part", "__bits")
    )
