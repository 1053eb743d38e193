"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned so that the signs of a vector's coordinates lose least
(iterative quantisation); the signs are its code. Codes are cut into tables; two vectors are candidates
when they agree in one table up to one flipped bit and their first 64 bits differ in at most ``MOST_BITS``.
Candidates are reranked by the cosine of the original vectors in double precision. A table has about
log2 of the number of vectors bits, so that cells don't fill up as the corpus grows, and there are as
many tables as the wanted recall needs at the threshold; short vectors get several rotations.

The rotations are fitted, in a task for each length, on about ``SAMPLE`` vectors or ``SAMPLE_BYTES`` (by hash of their id);
every vector is coded, indexed and searched for. Vectors equal in every component are one class, expanded
by counts only. In full cells, vectors within half the threshold's angle of one leader are a clique: all
of them link (angles add up), so their links are counted without a pair being made; pairs are made of
what is left. Classes, candidates and components stay distributed.

Cases: vectors that are null, zero, or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths link with none of each other (beyond the ``FITTED``
most frequent lengths rotations are random, not fitted); repeated vec_ids are one node whose links are
counted for each row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import components, keep, prepare

THRESHOLD = 0.95
SAMPLE, SAMPLE_BYTES = 20_000, 128 << 20
FITTED = 8
LEAST_TABLE_BITS = 16
MOST_TABLE_BITS = 30
#: Chance that a pair at the threshold is found, by which tables are counted.
RECALL = 0.94
MOST_BITS = 18
#: A cell of so many vectors gets a leader, and those very near it are one clique.
HOT = 64
ROUNDS = 50


def tables(total: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a table for so many vectors, and how many tables the recall takes."""
    bits = min(MOST_TABLE_BITS, max(LEAST_TABLE_BITS, (max(total, 1) - 1).bit_length()))
    flip = math.acos(threshold) / math.pi  # chance that a direction parts two vectors at the threshold
    found = (1 - flip) ** bits + bits * flip * (1 - flip) ** (bits - 1)
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - found)))


def fit(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) of unit vectors by iterative quantisation.

    Where there are fewer dimensions than bits, further rotations begin from other random ones.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    low = centred @ axes
    rng, found = np.random.default_rng(seed), []
    for k in range(-(-bits // low.shape[1])):
        turn = np.linalg.qr(rng.normal(size=(low.shape[1], low.shape[1])))[0]
        for _ in range(rounds if k == 0 else 0):  # further ones stay random: optima would resemble each other
            codes = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(codes.T @ low)
            turn = (u @ vt).T
        found.append(axes @ turn)
    return mean, np.concatenate(found, axis=1)[:, :bits]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that can link."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def _coded(good: DataFrame, threshold: float) -> tuple[DataFrame, int] | None:
    """vec_id, embedding, d (length), code (first 64 bits), cells (one for each table); and the bits of a table."""
    lengths = good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d")
    top = lengths.limit(FITTED).collect()
    if not top:
        return None
    width, count = tables(lengths.agg(F.sum("n")).first()[0], threshold)
    bits = max(64, width * count)
    key = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    wanted = F.lit(False)
    for row in top:
        most = max(1024, min(SAMPLE, SAMPLE_BYTES // (8 * row["d"])))
        share = min(1 << 20, -(-(most << 20) // row["n"]))  # how many vectors the rotation sees; no vector is left out later
        wanted = wanted | ((F.size("embedding") == row["d"]) & (key < share))

    def fitted(held: pa.Table) -> pa.Table:
        d = held.column("d")[0].as_py()
        mean, project = fit(_unit(held.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, d)), bits)
        return pa.table({"d": pa.array([d], pa.int32()), "mean": [mean.tobytes()], "project": [project.tobytes()]})

    # a task for each length: its sample is bounded, and linear algebra has one thread there
    some = good.where(wanted).select(F.size("embedding").alias("d"), "embedding")
    found = some.groupBy("d").applyInArrow(fitted, "d int, mean binary, project binary").collect()
    models = {r["d"]: (np.frombuffer(r["mean"]), np.frombuffer(r["project"]).reshape(r["d"], -1)) for r in found}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(models)
        for batch in batches:
            lists = batch.column(1)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            flat, begin = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
            signs = np.zeros((len(size), bits), np.uint8)
            for d in np.unique(size).tolist():
                if d not in known:
                    known[d] = _random(d, bits)
                mean, project = known[d]
                rows = np.flatnonzero(size == d)
                signs[rows] = (_unit(flat[begin[rows][:, None] + np.arange(d)]) - mean) @ project >= 0
            code = np.packbits(signs[:, :64], axis=1).view(">u8").astype(np.int64).ravel()
            cells = signs[:, : width * count].reshape(len(size), count, width) @ (1 << np.arange(width)[::-1])
            cells = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel(), pa.int32()), count).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(size, pa.int32()), pa.array(code), cells], names=["vec_id", "embedding", "d", "code", "cells"])

    return keep(good.mapInArrow(encode, "vec_id long, embedding array<double>, d int, code long, cells array<int>"), "codes"), width


def _random(d: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(d)
    turns = [np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(-(-bits // d))]
    return np.zeros(d), np.concatenate(turns, axis=1)[:, :bits]


def _linked(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of a cosine of at least ``least``, in double precision, of the original vectors."""

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            x, y = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            near = np.zeros(0, bool)
            if len(size):
                xy, xx, yy = (np.add.reduceat(v, begin) for v in (x * y, x * x, y * y))
                near = xy / (np.sqrt(xx) * np.sqrt(yy)) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))

    one = reps.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    two = reps.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(rerank, "a long, b long")


def _cliques(at: DataFrame, reps: DataFrame, threshold: float) -> DataFrame | None:
    """v, c: vectors within half the threshold's angle of a leader c, so that all of a leader's link (kept).

    Each cell of ``HOT`` vectors has a leader; a vector goes to the least of those its cells offer, or that
    these leaders have gone to themselves. Cliques of few members are let go: their pairs are few.
    """
    cells = at.groupBy("t", "cell", "d").agg(F.count(F.lit(1)).alias("n"), F.min_by("v", F.struct(F.xxhash64("v"), "v")).alias("leader"))
    cells = keep(cells.where(F.col("n") >= HOT).drop("n"), "hot-cells")
    if cells.isEmpty():
        return None
    half = math.sqrt((1 + threshold) / 2) + 1e-9
    offers = at.join(cells, ["t", "cell", "d"]).select(F.col("v").alias("a"), F.col("leader").alias("b")).distinct()
    close = keep(_linked(offers, reps, half), "led")
    gone = close.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("to"))
    further = close.join(gone, "b").select("a", F.col("to").alias("b")).distinct().join(close, ["a", "b"], "left_anti")
    best = close.union(_linked(further, reps, half)).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c"))
    best = keep(best, "cliques")
    large = best.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT // 4).select("c")
    return best.join(large, "c").select("v", "c")


def _candidates(at: DataFrame, width: int, reps: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of different vectors, not of one clique, that share a cell up to one bit.

    ``at``: v, code, d, t, cell, c (the clique, or null). Vectors outside cliques meet all others of a cell.
    Members of cliques meet those of others only where the cliques' leaders are near enough for a link.
    """
    flips = F.array(*[F.col("cell").bitwiseXOR(F.lit(x)) for x in [0] + [1 << k for k in range(width)]])
    on = ["t", "cell", "d"]
    loose = at.where("c is null").select(F.col("v").alias("a"), F.col("code").alias("code_a"), *on)
    probe = at.select(F.col("v").alias("b"), F.col("code").alias("code_b"), "d", "t", "c", F.explode(flips).alias("cell"))
    close = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= MOST_BITS
    met = loose.join(probe, on).where((F.col("a") < F.col("b")) | F.col("c").isNotNull()).where(close).select("a", "b")
    members = at.where("c is not null")
    seats = members.select(*on, F.col("c").alias("c1")).distinct()
    beside = members.select("t", "d", "c", "cell").distinct().select("t", "d", F.col("c").alias("c2"), F.explode(flips).alias("cell")).distinct()
    meeting = keep(seats.join(beside, on).where("c1 < c2"), "meeting-cliques")
    # two members within the threshold's angle: their leaders are within twice that
    apart = math.cos(min(math.pi, 2 * math.acos(threshold))) - 1e-9
    possible = _linked(meeting.select(F.col("c1").alias("a"), F.col("c2").alias("b")).distinct(), reps, apart)
    meeting = meeting.join(possible.select(F.col("a").alias("c1"), F.col("b").alias("c2")), ["c1", "c2"])
    one = members.select(*on, F.col("c").alias("c1"), F.col("v").alias("a"), F.col("code").alias("code_a"))
    two = members.select("t", "d", F.col("c").alias("c2"), F.col("v").alias("b"), F.col("code").alias("code_b"), F.explode(flips).alias("cell"))
    across = meeting.join(one, [*on, "c1"]).join(two, [*on, "c2"]).where(close).select("a", "b")
    return met.union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    prepare(vectors.sparkSession)
    plain = vectors.select("vec_id")
    found = _coded(usable(vectors.where("vec_id is not null")), threshold)
    if found is None:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    coded, width = found
    members = coded.select("vec_id", F.sha2(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), 256).alias("same"))
    members = keep(members, "vector-classes")
    classes = keep(members.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many")), "vector-counts")
    reps = coded.join(classes.select(F.col("rep").alias("vec_id")).distinct(), "vec_id", "left_semi").dropDuplicates(["vec_id"])
    reps = keep(reps, "vector-reps")

    at = reps.select(F.col("vec_id").alias("v"), "code", "d", F.posexplode("cells").alias("t", "cell"))
    cliques = _cliques(at, reps, threshold)
    if cliques is None:
        cliques = reps.select(F.col("vec_id").alias("v"), F.col("vec_id").alias("c")).limit(0)
    cliques = keep(cliques, "cliques")
    pairs = keep(_candidates(at.join(cliques, "v", "left"), width, reps, threshold), "vector-pairs")
    links = keep(_linked(pairs, reps, threshold), "vector-links")

    many = classes.select("rep", "many")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(many.withColumnRenamed("rep", "b"), "b").select(F.col("a").alias("rep"), "many")
    # in a clique each member links with all others: counted, not paired
    sizes = cliques.join(many.withColumnRenamed("rep", "v"), "v")
    whole = keep(sizes.groupBy("c").agg(F.sum("many").alias("all"), F.min("v").alias("least")), "clique-sizes")  # so that a large one's rows can be split
    inside = sizes.join(whole, "c").select(F.col("v").alias("rep"), (F.col("all") - F.col("many")).alias("many"))
    others = others.union(inside).groupBy("rep").agg(F.sum("many").alias("linked"))
    stars = cliques.join(whole, "c").select(F.col("v").alias("a"), F.col("least").alias("b"))
    merged = components(links.union(stars)).withColumnRenamed("node", "rep")
    named = classes.join(others, "rep", "left").join(merged, "rep", "left")
    named = named.select("same", (F.coalesce("linked", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = members.join(named, "same").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = plain.join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
