"""Sharding by extendible hashing.

A directory is indexed by the first bits of a hash of doc_id. A bucket above the byte limit splits on
the next bit, and only such a bucket; the shards are the buckets that remain. Sizes are summed once by
a fine prefix (a few hundred prefixes for each shard), the directory is made from these sums, and the
documents meet it in one equi-join; buckets still too large at the finest prefix are split again on
more bits.

Cases: null and empty texts have 0 bytes and still get a shard; null doc_ids hash as the empty
string; rows that share a doc_id share a shard; a bucket that no further bit can split (rows of one id)
stays above the limit at the last depth; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import keep

LIMIT = 8 << 20
BITS = 32
#: Depths that are summed from one set of prefixes.
STEP = 8


def hash_bits(key: Column) -> Column:
    """The first 32 bits of md5, as a long: the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth, shard (the prefix as an integer), shard_bytes of each document."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sized = keep(docs.select("doc_id", hash_bits(F.col("doc_id")).alias("h"), size.alias("n_bytes")), "shards")
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    fine = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 8)
    cells = keep(sized.groupBy(F.shiftright("h", BITS - fine).alias("cell")).agg(F.sum("n_bytes").alias("bytes")), "prefixes")
    leaves = _leaves(cells, 0, fine, limit, final=fine == BITS)
    done = [_assign(sized, leaves, fine)]
    while fine < BITS:
        rest = sized.join(leaves.where("depth is null").withColumnRenamed("cell", "_cell"), F.shiftright("h", BITS - fine) == F.col("_cell"), "left_semi")
        if rest.isEmpty():
            break
        sized, start, fine = rest, fine + 1, min(BITS, fine + 8)
        cells = keep(sized.groupBy(F.shiftright("h", BITS - fine).alias("cell")).agg(F.sum("n_bytes").alias("bytes")), "prefixes")
        leaves = _leaves(cells, start, fine, limit, final=fine == BITS)
        done.append(_assign(sized, leaves, fine))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _leaves(cells: DataFrame, start: int, fine: int, limit: int, final: bool) -> DataFrame:
    """For each fine prefix the bucket it ends in: the least depth, from ``start`` on, at which its bucket fits.

    Folded by ``STEP`` bits at a time: sums of the last depths are made from the fine prefixes, those of
    the depths before from the prefixes that are left when these bits are gone, and so on.
    """
    middle = max(start, fine - STEP)
    at = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(middle), F.lit(fine))).alias("depth"))
    at = at.withColumn("shard", F.expr(f"shiftright(cell, {fine} - depth)"))
    sums = at.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.lit(final) & (F.col("depth") == fine)))
    found = at.join(fits, ["depth", "shard"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("leaf"))
    near = cells.select("cell").join(found, "cell", "left")
    if middle > start:
        prefix = F.shiftright("cell", fine - middle)
        coarse = keep(cells.groupBy(prefix.alias("cell")).agg(F.sum("bytes").alias("bytes")), "prefixes")
        above = _leaves(coarse, start, middle, limit, final=False).where("depth is not null")
        above = above.select(F.col("cell").alias("_prefix"), F.struct("depth", "shard", "shard_bytes").alias("_leaf"))
        near = near.join(above, prefix == F.col("_prefix"), "left").withColumn("leaf", F.coalesce("_leaf", "leaf"))
    return keep(near.select("cell", "leaf.*"), "leaves")


def _assign(sized: DataFrame, leaves: DataFrame, fine: int) -> DataFrame:
    joined = sized.join(leaves.where("depth is not null"), F.shiftright("h", BITS - fine) == F.col("cell"))
    return joined.select("doc_id", "n_bytes", "depth", "shard", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write whole documents as Parquet, a folder for each shard, doc_id ascending inside.

    Columns of ``docs`` named depth or shard give way to the shard's.
    """
    docs = docs.drop("depth", "shard")
    place = shard(docs, limit).select("doc_id", "depth", "shard").distinct()
    placed = docs.alias("d").join(place.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select("d.*", "p.depth", "p.shard")
    placed.repartition("depth", "shard").sortWithinPartitions("depth", "shard", "doc_id").write.partitionBy("depth", "shard").parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL for the rows of ``shard``."""
    return f"""
    WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
    p AS (SELECT d.doc_id, d.n_bytes, g.depth::INTEGER AS depth, (h >> (32 - g.depth))::BIGINT AS shard
          FROM d, range(0, 33) AS g(depth)),
    b AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes FROM p GROUP BY ALL),
    f AS (SELECT p.doc_id, p.n_bytes, p.depth, p.shard, b.shard_bytes,
                 row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
          FROM p JOIN b USING (depth, shard) WHERE b.shard_bytes <= {limit} OR depth = 32)
    SELECT doc_id, n_bytes, depth, shard, shard_bytes FROM f WHERE k = 1"""
