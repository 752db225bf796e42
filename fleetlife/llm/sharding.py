"""Sharding by rendezvous hashing: a record goes to the shard with the best weighted draw.

Each (key, shard) pair has a draw of its own, so a further shard only takes the records for which its
draw is the best, and a removed one only gives away its own. A shard of weight w gets w parts of all keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlife.llm.ranks import numbered

#: Draws have 52 bits: they are exact as doubles.
DRAW_BITS = 52


def draw(*parts: Column) -> Column:
    """A number of 0 to 2**52 - 1 from the first 13 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a string key. Ties go to the lower number.

    The best shard has the smallest -ln(u) / weight, with u the pair's draw in (0, 1). A null key
    counts as the empty one. Shards of weight 0 get nothing.
    """
    stable = F.coalesce(key, F.lit(""))
    choices = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (draw(stable, F.lit(str(shard))).cast("double") + 0.5) / float(1 << DRAW_BITS)
            choices.append(F.struct((-F.log(u) / float(weight)).alias("cost"), F.lit(shard).alias("shard")))
    if not choices:
        raise ValueError("no shard has a weight above 0")
    return (F.least(*choices) if len(choices) > 1 else choices[0])["shard"]


def assign_shards(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with ``shard``, and ``grown_shard`` if ``grown`` names the weights after a change.

    Rows with equal keys (null: one more key) stay together. No shuffle.
    """
    own = F.col(key).cast("string")
    out = docs.withColumn("shard", rendezvous(own, weights))
    return out.withColumn("grown_shard", rendezvous(own, grown)) if grown is not None else out


def shard_table(
    docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document its key, size, checksum, shard, slot in the shard (gapless from 0) and grown shard.

    Size: UTF-8 bytes plus 8; a null text has none, and the checksum of the empty text. The slots of
    a shard are in the order of a hash of key and checksum; only these small rows are shuffled.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    rows = assign_shards(rows, weights, grown, key)
    place = draw(F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("text_crc32").cast("string"))
    return numbered(rows, ["shard"], place, [key, "size"], "slot")
