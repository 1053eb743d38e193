"""Packing token sequences by cutting-stock column generation.

A document's ids (its text's, then the end id) are cut at multiples of the sequence length; full
pieces fill a sequence each. What is left over, one piece of less than a sequence for each document
at most, is packed by a cutting-stock programme over the histogram of lengths: a restricted linear
programme chooses how often to use each pattern of lengths, an unbounded-knapsack dynamic programme
over the dual prices finds patterns that improve it, and the optimum is rounded down; what rounding
leaves over is packed best fit first. Patterns are then dealt to documents by their rank in their
length class. Where there are more than ``CLASSES`` lengths, neighbours are put in one class (that of
the longest) where this wastes least; short lengths, of which a sequence holds many, stay exact.

The driver sees the histogram (at most one row for each length below the sequence's) and the patterns,
never documents.

Cases: null and empty texts are one id long; repeated doc_ids are separate documents (told apart by
crc32 of their texts; rows equal in both are alike, so it does not matter which piece is whose); null
doc_ids are kept; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import hash_block, keep, prepare, ranked
from tideframe.llm.tokens import encoder, gathered, tokenizer_path

LENGTH = 4096
#: Length classes of the programme.
CLASSES = 256
#: Patterns taken from one pricing.
COLUMNS = 32
PIECES = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long"


def classes(histogram: dict[int, int], most: int = CLASSES) -> dict[int, int]:
    """Length -> its class, the longest length in it; at most ``most`` classes, merged where least is wasted."""
    lengths = sorted(histogram)
    top, held = np.array(lengths), np.array([histogram[n] for n in lengths], float)
    while len(top) > most:
        waste = held[:-1] * (top[1:] - top[:-1])
        merges = max(1, (len(top) - most) // 16)  # the cheapest ones, no two side by side
        dropped = np.zeros(len(top), bool)
        for k in np.argsort(waste, kind="stable").tolist():
            if merges and not dropped[k] and not dropped[k - 1 if k else 0] and not dropped[k + 1]:
                dropped[k] = True
                merges -= 1
        at = np.flatnonzero(dropped)
        held[at + 1] += held[at]
        top, held = top[~dropped], held[~dropped]
    return dict(zip(lengths, top[np.searchsorted(top, lengths)].tolist(), strict=True))


class Knapsack:
    """Unbounded knapsack over all capacities: how much ``sizes`` of the ``values`` are worth at most."""

    def __init__(self, sizes: list[int], values: np.ndarray, capacity: int):
        self.best, self.steps = np.zeros(capacity + 1), []
        for s, v in zip(sizes, values.tolist(), strict=True):
            k = 1
            while v > 1e-12 and k * s <= capacity:  # 1, 2, 4, ... pieces: together any number of them
                total = self.best[: -k * s] + k * v
                better = total > self.best[k * s :] + 1e-12
                if better.any():
                    self.steps.append((s, k, better))
                    self.best[k * s :] = np.where(better, total, self.best[k * s :])
                k *= 2

    def pattern(self, c: int) -> Counter:
        """The sizes that make ``best[c]``."""
        found = Counter()
        for s, k, better in reversed(self.steps):
            if c >= k * s and better[c - k * s]:
                found[s] += k
                c -= k * s
        return found


def _product(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A matrix times a vector by one thread: threaded linear algebra may lock beside the driver's JVM."""
    return np.einsum("ij,j->i", matrix, vector)


def _inverse(matrix: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan elimination by rows, largest pivot first, by one thread; None of a singular matrix."""
    n = len(matrix)
    both = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        pivot = k + int(np.argmax(np.abs(both[k:, k])))
        if abs(both[pivot, k]) < 1e-11:
            return None
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        change = both[:, k].copy()
        change[k] = 0
        rows = np.flatnonzero(change)
        both[rows] -= np.multiply.outer(change[rows], both[k])
    return both[:, n:]


class _Programme:
    """The restricted linear programme: fewest bins of known patterns that meet every size's demand.

    Revised simplex with the basis inverse; rows are the sizes, the first basis has one pattern for each.
    """

    def __init__(self, sizes: list[int], need: np.ndarray, capacity: int):
        self.row = {s: i for i, s in enumerate(sizes)}
        need = need * (1 + 1e-6 * np.random.default_rng(1).random(len(need)))  # no two exchanges tie, so none go in circles
        self.need = need
        self.columns = np.diag([float(capacity // s) for s in sizes])  # one row for each pattern
        self.basis = np.arange(len(sizes))
        self.inverse = np.diag([1.0 / (capacity // s) for s in sizes])
        self.used, self.exchanges = _product(self.inverse, need), 0

    def add(self, patterns: list[Counter]) -> None:
        new = np.zeros((len(patterns), len(self.row)))
        for k, pattern in enumerate(patterns):
            for s, n in pattern.items():
                new[k, self.row[s]] = n
        self.columns = np.concatenate([self.columns, new])

    def solve(self, tolerance: float) -> np.ndarray:
        """Exchanges patterns until none known is worth more than a bin; returns the prices of the sizes."""
        barred = np.zeros(len(self.columns), bool)
        for _ in range(20 * len(self.need) + 200):
            dual = self.inverse.sum(axis=0)  # every pattern costs one bin
            worth = np.where(barred, 0, _product(self.columns, dual))
            k = int(np.argmax(worth))
            if worth[k] <= 1 + tolerance:
                break
            change = _product(self.inverse, self.columns[k])
            ratio = np.where(change > 1e-7, self.used / np.where(change > 1e-7, change, 1), np.inf)
            theta = ratio.min()
            if not np.isfinite(theta):
                barred[k] = True
                continue
            out = int(np.argmax(np.where(ratio <= theta + 1e-9, change, 0)))  # of equal ones the safest
            self.used = np.maximum(self.used - theta * change, 0)
            self.used[out] = theta
            self.basis[out] = k
            self.inverse[out] /= change[out]
            change[out] = 0
            self.inverse -= np.multiply.outer(change, self.inverse[out])
            self.exchanges += 1
            if self.exchanges % 200 == 0:  # against drift
                fresh = _inverse(self.columns[self.basis].T)
                if fresh is None:  # begin again, with all patterns found
                    self.basis = np.arange(len(self.need))
                    fresh = np.diag(1.0 / np.diag(self.columns[self.basis]))
                self.inverse = fresh
                self.used = np.maximum(_product(self.inverse, self.need), 0)
        else:
            warnings.warn("the packing programme stopped at its limit of exchanges; its plan is valid, but may be further from the optimum", stacklevel=2)
        return self.inverse.sum(axis=0)

    def drop(self, most: int) -> None:
        """Forgets the oldest patterns out of use beyond ``most``."""
        if len(self.columns) > most:
            stays = np.zeros(len(self.columns), bool)
            stays[-most // 2 :] = True
            stays[: len(self.need)] = True
            stays[self.basis] = True
            self.basis = (np.cumsum(stays) - 1)[self.basis]
            self.columns = self.columns[stays]


def cutting_stock(demand: dict[int, int], capacity: int, tolerance: float = 2e-3, most_rounds: int = 1000) -> list[tuple[Counter, int]]:
    """Patterns (size -> how often) and how many bins use each; every size's demand is met exactly.

    Column generation from the best-fit patterns. A pricing by the knapsack gives the best pattern and the
    best with each size, and a lower bound: prices divided by the best pattern's worth. Prices are drawn
    towards those of the best bound, which keeps them from swinging. Stops when the programme is within
    ``tolerance`` of the bound (or after ``most_rounds`` pricings: the plan is then valid, only not proven
    near the optimum).
    """
    sizes = sorted(s for s, n in demand.items() if n > 0)
    if not sizes:
        return []
    width = np.array(sizes)
    need = np.array([demand[s] for s in sizes], float)
    programme = _Programme(sizes, need, capacity)
    programme.add([p for p, _ in best_fit(demand, capacity)])
    bound, centre = 0.0, None
    for _ in range(most_rounds):
        dual = programme.solve(tolerance / 8)
        fewest = programme.used.sum()
        tried: list[Counter] = []
        for prices in ([0.8 * centre + 0.2 * dual] if centre is not None else []) + [dual]:
            sack = Knapsack(sizes, prices, capacity)
            if (found := float((prices * need).sum()) / max(1.0, sack.best[capacity])) > bound:
                bound, centre = found, prices
            worth = prices + sack.best[capacity - width]
            for i in np.argsort(-worth, kind="stable")[:COLUMNS].tolist():
                pattern = sack.pattern(capacity - sizes[i])
                pattern[sizes[i]] += 1
                if pattern not in tried and sum(n * dual[programme.row[s]] for s, n in pattern.items()) > 1 + tolerance / 8:
                    tried.append(pattern)
            if tried or fewest <= (1 + tolerance) * bound:
                break
        if not tried or fewest <= (1 + tolerance) * bound:
            break
        programme.drop(20 * len(sizes) + 1000)
        programme.add(tried)
    patterns = [Counter({sizes[i]: int(n) for i, n in enumerate(programme.columns[k]) if n}) for k in programme.basis.tolist()]
    used = programme.used
    left = {s: demand[s] for s in sizes}
    plan: list[tuple[Counter, int]] = []
    for p, x in sorted(zip(patterns, used, strict=True), key=lambda t: -t[1]):
        n = min([int(x + 1e-4), *(left[s] // k for s, k in p.items())])
        if n > 0:
            plan.append((p, n))
            for s, k in p.items():
                left[s] -= n * k
    return plan + best_fit(left, capacity)


def fullest(left: dict[int, int], room: int) -> Counter:
    """Sizes, each at most as often as it is left, whose sum comes nearest to ``room`` from below.

    Bounded knapsack by binary splitting of counts over a bitset of reachable sums (an integer).
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for s in sorted(left, reverse=True):
        count, k = min(left[s], room // s), 1
        while count > 0:
            k = min(k, count)
            steps.append((s, k, reach))
            reach |= reach << k * s & mask
            count -= k
            k *= 2
        if reach >> room & 1:
            break
    found, at = Counter(), reach.bit_length() - 1
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            found[s] += k
            at -= k * s
    return found


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Bins one after another: the largest size left, and what fills the rest best; alike bins are one entry."""
    left = {s: n for s, n in left.items() if n > 0}
    plan: list[tuple[Counter, int]] = []
    while left:
        s = max(left)
        bin_ = Counter({s: 1}) + fullest(left | {s: left[s] - 1}, capacity - s)
        times = min(left[s] // n for s, n in bin_.items())
        plan.append((bin_, times))
        left = {s: n for s in left if (n := left[s] - bin_[s] * times) > 0}
    return plan


def cut(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The pieces of each document; its ids are encoded once, here."""
    prepare(docs.sparkSession)
    path = path or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in gathered(batches):
            out = []
            for doc, text, ids in zip(batch.column(0).to_pylist(), batch.column(1), enc.each(batch.column(1)), strict=True):
                copy = zlib.crc32(text.as_buffer()) if text.is_valid and len(text.as_buffer()) else -1
                for a in range(0, len(ids), length):
                    part = ids[a : a + length]
                    out.append((doc, copy, a, len(part), zlib.crc32(part), len(ids)))
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES)


def pack(pieces: DataFrame, length: int = LENGTH, most: int = CLASSES) -> DataFrame:
    """Adds sequence_id and offset to pieces (stored: they are read three times)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = histogram.pop(length, 0)
    grouped = classes(histogram, most)
    demand: Counter = Counter()
    for n, k in histogram.items():
        demand[grouped[n]] += k
    plan = cutting_stock(demand, length)
    if whole:
        plan.append((Counter({length: 1}), whole))
        grouped[length] = length
    tops = sorted(set(grouped.values()))
    # the class of a length is the first that is not below it
    size = F.element_at(F.filter(F.array(*[F.lit(int(t)) for t in tops]), lambda t: t >= F.col("length")), 1) if tops else F.lit(0)
    pieces = pieces.withColumn("size", size.cast("int"))
    order = [F.xxhash64("doc_id", "copy", "start"), F.col("doc_id"), F.col("copy"), F.col("start")]
    placed = ranked(pieces, ["size"], order, hash_block(order[0]), "rank").withColumn("rank", F.col("rank") - 1)
    # A row for each (pattern, size): pieces of ranks [first, first + times * each) go to its bins.
    taken, rows, base = Counter(), [], 0
    for pattern, times in plan:
        at = 0
        for s in sorted(pattern, reverse=True):
            each = pattern[s]
            rows.append((s, taken[s], taken[s] + times * each, each, base, at))
            taken[s] += times * each
            at += s * each
        base += times
    slots = spark.createDataFrame(rows, "size int, first long, stop long, each int, base long, at int")
    by_size = slots.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("first", "stop", "each", "base", "at"))).alias("slots"))
    found = F.element_at(F.filter("slots", lambda s: s["stop"] > F.col("rank")), 1)
    dealt = placed.join(F.broadcast(by_size), "size").withColumn("s", found)  # as many rows as classes
    k = F.col("rank") - F.col("s.first")
    dealt = dealt.withColumn("sequence_id", F.col("s.base") + F.expr("(rank - s.first) div s.each"))
    dealt = dealt.withColumn("_at", F.col("s.at") + (k % F.col("s.each")) * F.col("size"))
    before = Window.partitionBy("sequence_id").orderBy("_at", "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("s", "_at", "rank", "size")


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, most: int = CLASSES) -> DataFrame:
    """Pieces of all documents with their sequences; a sequence's pieces are gapless from offset 0."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    packed = pack(keep(cut(docs, path, length), "pieces"), length, most)
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    is_power = F.expr("total & (total - 1)") == 0
    padded = packed.withColumn("total", total).withColumn("sequence_length", F.when(is_power, F.col("total")).otherwise(F.lit(length)))
    return padded.select(*columns, "sequence_length")
