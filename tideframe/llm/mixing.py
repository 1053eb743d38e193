"""Mixing sources to target weights by subset-sum budgets.

Each source's budget is its share of all words by weight; a budget never exceeds ``most`` times the
source, the excess is dealt again by weight. A document is taken ``budget // source`` times whole,
and the rest of the budget is a subset-sum problem over the source's documents: they are counted by
exact length, a proportional part of the counts is taken first (fractions are dealt on along the
lengths, so that about the longest document's words are left), and a bounded-knapsack dynamic
programme over all that is left of the counts fills the remaining budget; documents are taken again (up
to ``most`` times) only where single ones miss the nearest sum. Which documents of a length are taken is
decided by rank under a seeded hash.

The programme runs in one task for each source, on its histogram of lengths (not its documents).

Cases: null and empty texts have size 0 and take nothing; sources without words have target 0; the
null source is a source of its own, last in order; repeated rows are separate documents; an empty
table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import hash_block, keep, ranked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 42
#: The rest is widened up to so many words while the dynamic programme misses the nearest sum.
WINDOW = 1 << 20


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Budget of each source: by weight, at most ``most`` times its size, the excess dealt again."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, total = dict(order), float(sum(n for _, n in order))
    found, free, rest = {}, [s for s, _ in order], total
    while free:
        unit = rest / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * size[s]]
        if not full:
            found |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            found[s] = float(most * size[s])
            rest -= found[s]
        free = [s for s in free if s not in full]
    return found


def proportional(lengths: np.ndarray, counts: np.ndarray, words: int) -> np.ndarray:
    """The same share of the documents of every length, about ``words`` words in all and never more.

    What a length's share leaves below a whole document goes on to the next shorter length, so that
    lengths of one document take part; the words missed in the end are fewer than the longest has.
    """
    total = int((lengths * counts).sum())
    take, left = np.zeros(len(lengths), object), 0  # left: in 1 / total words
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, c = int(lengths[i]), int(counts[i])
        left += c * n * words
        take[i] = min(c, left // (n * total))
        left -= take[i] * n * total
    return take


def nearest(lengths: np.ndarray, free: list[tuple[int, int]], rest: int, goals: list[int]) -> dict[int, int]:
    """How many documents of each length index make the sum nearest to ``rest``, of ``free`` (index, count).

    Bounded knapsack by binary splitting of counts over a bitset of reachable sums (an integer). Each
    sum keeps the item that reached it first, from which the choice is read back; the items end only
    when one of ``goals`` (sums that can't be bettered) is reached.
    """
    top = max(rest, min(2 * rest, rest + max((int(lengths[i]) for i, _ in free), default=0)))  # above rest sums may be nearer
    reach, mask = 1, (1 << (top + 1)) - 1
    first, items = np.zeros(top + 1, np.int32), []
    for i, count in free:
        if any(reach >> g & 1 for g in goals):
            break
        n, size = int(lengths[i]), 1
        count = min(count, top // n)
        while count > 0:
            k = min(size, count)
            if new := (reach << k * n) & mask & ~reach:
                raw = np.frombuffer(new.to_bytes((top >> 3) + 1, "little"), np.uint8)
                some = np.flatnonzero(raw)
                byte, bit = np.nonzero(np.unpackbits(raw[some, None], axis=1, bitorder="little"))
                first[some[byte] * 8 + bit] = len(items)
                items.append((i, k))
                reach |= new
            count -= k
            size *= 2
    at = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    if above := reach >> (rest + 1):
        least = rest + (above & -above).bit_length()
        at = least if least - rest < rest - at else at
    found: dict[int, int] = {}
    while at > 0:
        i, k = items[first[at]]
        found[i] = found.get(i, 0) + k
        at -= k * int(lengths[i])
    return found


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int, repeats: int = 0) -> np.ndarray:
    """How often to take documents of each length so that their words come nearest to ``budget``.

    Each document once, and up to ``repeats`` times more where single ones miss the nearest sum. A
    proportional part leaves a rest of about the longest document to the knapsack; where the nearest
    sum is missed, the rest is widened, up to ``WINDOW`` or the whole budget.
    """
    if not len(lengths) or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    lengths, counts = lengths.astype(object), counts.astype(object)
    short_first = np.argsort(lengths.astype(np.int64), kind="stable").tolist()  # short documents fill gaps best
    longest, total, step = int(max(lengths)), int((lengths * counts).sum()), int(np.gcd.reduce(lengths.astype(np.int64)))
    best, missed = np.zeros(len(lengths), object), budget
    most = total * (1 + repeats)
    least = max(min(budget % step, step - budget % step), budget - most)  # no sum is nearer
    for again in [0, repeats] if repeats else [0]:
        room = longest
        while True:
            take = proportional(lengths, counts, min(total, max(0, budget - room)))
            rest = budget - int((take * lengths).sum())
            free = [(i, int(counts[i] - take[i])) for i in short_first] + [(i, int(counts[i]) * again) for i in short_first]
            goals = [g for g in (rest - least, rest + least) if 0 <= g <= 2 * rest]
            found = nearest(lengths, free, rest, goals)
            for i, k in found.items():
                take[i] += k
            miss = abs(budget - int((take * lengths).sum()))
            if miss < missed:
                best, missed = take, miss
            wide = min(budget, max(WINDOW, longest))
            if missed <= least or room >= wide:
                break
            room = min(8 * room, wide)
        if missed <= least:
            break
    return best.astype(np.int64)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, tie (hash of the text), source, size, source_size, target, times, taken of each document."""
    spark = docs.sparkSession
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    sized = keep(docs.select("doc_id", F.xxhash64("text").alias("tie"), "source", size.alias("size")), "sizes")
    histogram = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sums = [(r["source"], r["words"]) for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()]
    goal = targets(sums, weights, most)
    rows = [(s, n, goal.get(s, 0.0), (int(goal.get(s, 0.0) // n) if n else 0)) for s, n in sums]
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, whole long")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        real = pdf[pdf["size"] > 0]
        budget = round(float(first["target"])) - int(first["whole"]) * int(first["source_size"])
        if first["whole"] >= most:
            budget = 0
        repeats = max(0, most - int(first["whole"]) - 1)
        extra = fill(real["size"].to_numpy(), real["n"].to_numpy(), max(0, int(budget)), repeats)
        return real[["source", "size", "n"]].assign(extra=extra)

    joined = histogram.alias("h").join(plan.alias("p"), F.col("h.source").eqNullSafe(F.col("p.source")))
    joined = joined.select("h.source", "h.size", "h.n", "p.source_size", "p.target", "p.whole")
    extra = joined.groupBy("source").applyInPandas(choose, "source string, size long, n long, extra long")
    key = F.xxhash64(F.lit(seed), "doc_id")
    order = [key, F.col("doc_id"), F.col("tie")]
    ranks = ranked(sized, ["source", "size"], order, hash_block(key), "rank")
    on = F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.size") == F.col("e.size"))
    chosen = ranks.alias("r").join(extra.alias("e"), on, "left").select("r.*", F.coalesce("e.extra", F.lit(0)).alias("extra"), F.coalesce("e.n", F.lit(1)).alias("n"))
    out = chosen.alias("c").join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")))
    more = F.expr("c.extra div c.n") + F.when(F.col("c.rank") <= F.col("c.extra") % F.col("c.n"), 1).otherwise(0)
    times = F.col("p.whole") + more
    times = F.when(F.col("c.size") > 0, times).otherwise(0)
    out = out.select("c.doc_id", "c.tie", "c.source", "c.size", "p.source_size", "p.target", times.alias("times"))
    return out.withColumn("taken", F.col("size") * F.col("times"))


def taken(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: each row none, once or several times.

    Rows alike in doc_id, text and source are taken together as often as the mix takes them in all.
    """
    kinds = mix(docs, **how).groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("source").alias("_source"))
    kinds = keep(kinds.agg(F.count(F.lit(1)).alias("_n"), F.sum("times").alias("_times")).where("_times > 0"), "taken")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tie")) & F.col("source").eqNullSafe(F.col("_source"))
    out = docs.join(kinds.where("_n = 1"), on)
    alike = kinds.where("_n > 1")
    if not alike.isEmpty():
        out = out.unionByName(docs.join(alike, on).dropDuplicates(["doc_id", "text", "source"]))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*docs.columns)
