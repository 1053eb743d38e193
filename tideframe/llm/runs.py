"""Periodic runs of words, from maximal pairs of the LCP-interval tree, and texts without their repeats.

A run is a stretch of words with smallest period q (words q apart are identical), at least 2q and
``least`` words long, that no neighbouring word extends. Its first word s and s + q begin a maximal pair:
equal stretches of length l that differ (or end) on the left and on the right; the run is l + q words
long. So runs are the maximal pairs with a distance of at most l, and of at least ``least`` - l; no
stretch is extended to find them.

Per batch of whole documents: suffixes are sorted by prefix doubling (a document's suffixes by
themselves), common prefixes of neighbours follow from the irreducible ones, which are compared word by
word; the LCP-interval tree is walked bottom-up with a stack. A node keeps the places of its suffixes
in text order, each with the class of its left word. When children are joined, the smaller list goes
into the larger one and each place is paired with its neighbours there, if their left words are of
different classes. Neighbours suffice: places of one node that lie between s and s + q would give the
run a shorter period. Other maximal pairs found have multiples of a run's period as distance; of pairs
that span the same words the shortest distance is the period.

A distance of at most l and a length of 12 need l >= 6, so documents in which no six words repeat
have no runs, and nodes above depth 6 are not kept (for ``least`` in general: half of it). Groups of
suffixes whose nearest places are further apart than their longest common prefix hold no run either.

No rows are shuffled; a document is worked on by one task, in memory linear in its words.

Cases: null and empty texts have no words and no runs; null doc_ids and repeated rows are documents of
their own; words are compared exactly, case included; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import prepare

LEAST = 12
#: Words that are worked on at once (a longer document by itself), and words remembered by number.
BATCH_WORDS = 1 << 19
MEMORY_WORDS = 1 << 19
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Numbers(dict):
    """A number above 0 for each word met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) + 1
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def has_repeat(ids: np.ndarray, gram: int) -> bool:
    """Whether some ``gram`` words may come again in a document (by hash: no repeat is missed)."""
    if len(ids) <= gram:
        return False
    word, total = _mixed(ids.astype(np.uint64)), np.zeros(len(ids) - gram + 1, np.uint64)
    for k in range(gram):
        total = total * np.uint64(0xD6E8FEB86659FD93) + word[k : k + len(total)]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def suffix_order(ids: np.ndarray, doc: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places in suffix order, documents one after another.

    ``ids`` are above 0; ``stop`` is the end of each place's document. Prefix doubling: a rank is the
    first position of the group of suffixes that agree so far; only groups of several are sorted on.
    """
    n = len(ids)
    key = doc.astype(np.int64) << 32 | ids
    order = np.argsort(key)

    def heads(sorted_key: np.ndarray) -> np.ndarray:
        """Position of the first of each element's group."""
        fresh = np.append(True, sorted_key[1:] != sorted_key[:-1])
        return np.maximum.accumulate(np.where(fresh, np.arange(len(sorted_key)), 0))

    rank = np.empty(n, np.int64)
    rank[order] = heads(key[order])
    k = 1
    open_ = np.arange(n)  # positions in ``order`` that are in groups of several
    while True:
        first = rank[order[open_]]
        same = first[1:] == first[:-1]
        open_ = open_[np.append(same, False) | np.append(False, same)]
        if not len(open_):
            return order
        place = order[open_]
        on = place + k
        after = np.where(on < stop[place], rank[np.minimum(on, n - 1)] + 1, 0)
        key = rank[place] << 32 | after
        by = np.argsort(key)
        order[open_] = place = place[by]
        key = key[by]
        # A group's positions are consecutive, so those of its parts are too.
        rank[place] = open_[heads(key)]
        k *= 2


def common_prefixes(ids: np.ndarray, doc: np.ndarray, stop: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order`` (0 across documents).

    In text order these fall by one at most from place to place, and just by one where the words to the
    left agree too; only the others are compared, in steps that lengthen as fewer are left.
    """
    n = len(ids)
    before = np.empty(n, np.int64)
    before[order] = np.append(-1, order[:-1])
    linked = (before >= 0) & (doc[before] == doc)
    left, before_left = np.arange(n) - 1, before - 1
    agree = linked & (left >= 0) & (before_left >= 0)
    agree &= (ids[left] == ids[before_left]) & (doc[left] == doc) & (doc[before_left] == doc)
    own = np.flatnonzero(linked & ~agree)
    length = np.zeros(n, np.int64)
    a, b = own, before[own]
    limit = np.minimum(stop[a] - a, stop[b] - b)
    reach, width = np.zeros(len(own), np.int64), 4
    active = np.arange(len(own))
    while len(active):
        at = reach[active]
        span = np.arange(width)
        x, y = (a[active] + at)[:, None] + span, (b[active] + at)[:, None] + span
        equal = ids[np.minimum(x, n - 1)] == ids[np.minimum(y, n - 1)]
        equal &= (at[:, None] + span) < limit[active][:, None]
        run = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        reach[active] = at + run
        active = active[run == width]
        width = int(min(max(4, (1 << 20) // max(1, len(active))), 4 * width))
    length[own] = reach
    # The others: one less at each place further on.
    top = np.maximum.accumulate(np.where(agree, -1, np.arange(n)))
    length = np.where(agree, length[np.maximum(top, 0)] - (np.arange(n) - top), length)
    return length[order]


def _join(small: tuple[list, list], large: tuple[list, list], depth: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Puts the places of ``small`` into ``large``; maximal pairs of neighbours that are runs go to ``found``.

    Both hold places in text order and the classes of their left words; neighbours are looked up in
    ``large`` as it was, so that no two places of one child are paired.
    """
    places, classes = large
    entries = [(bisect_left(places, place), place, kind) for place, kind in zip(*small, strict=True)]
    for at, place, kind in entries:
        for other in (at - 1, at):
            if 0 <= other < len(places):
                q = abs(place - places[other])
                if q <= depth and q + depth >= least and classes[other] != kind:
                    first = min(place, places[other])
                    span = (first, first + q + depth)
                    if found.get(span, q) >= q:
                        found[span] = q
    for at, place, kind in reversed(entries):
        places.insert(at, place)
        classes.insert(at, kind)


def maximal_pairs(places: list[int], lcps: list[int], lefts: list[int], least: int, found: dict[tuple[int, int], int]) -> None:
    """Runs among suffixes in suffix order: (start, end) -> period, added to ``found``.

    ``lcps[i]``: common prefix of suffixes i - 1 and i, 0 where a group begins; ``lefts``: classes of left words.
    """
    stack: list[tuple[int, tuple[list, list]]] = []  # nodes on the way down: (depth, places with their classes)
    child = ([places[0]], [lefts[0]])
    for place, depth, left in zip([*places[1:], -1], [*lcps[1:], 0], [*lefts[1:], 0], strict=True):
        # ``child`` is complete: it belongs to the deepest node at or above it.
        while stack and stack[-1][0] >= depth:
            above, held = stack.pop()
            if len(held[0]) < len(child[0]):
                held, child = child, held
            _join(child, held, above, least, found)
            child = held
            if above == depth:
                break
        if depth:
            stack.append((depth, child))
        if place >= 0:
            child = ([place], [left])


def find(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document, ascending by start and period.

    ``ids`` holds the documents' words one after another, ``sizes`` their numbers of words.
    """
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    n = len(ids)
    if not n:
        return found
    shallow = (least + 1) // 2
    doc = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    stop = np.repeat(np.cumsum(sizes), sizes)
    order = suffix_order(ids, doc, stop)
    lcp = common_prefixes(ids, doc, stop, order)
    lcp[lcp < shallow] = 0
    shared = lcp > 0
    several = shared | np.append(shared[1:], False)
    order, lcp = order[several], lcp[several]
    if not len(order):
        return found
    # Groups of suffixes that share that many words: keep those with places near enough for their prefixes.
    group = np.cumsum(lcp == 0) - 1
    by_place = np.lexsort((order, group))
    near = np.full(group[-1] + 1, n)
    inside = np.flatnonzero(np.diff(group[by_place]) == 0)
    np.minimum.at(near, group[by_place][inside], np.diff(order[by_place])[inside])
    deepest = np.zeros(group[-1] + 1, np.int64)
    np.maximum.at(deepest, group, lcp)
    kept = (near <= deepest)[group]
    if not kept.any():
        return found
    places = order[kept]
    # The class of the left word; the first word of a document has none, which differs from all.
    lefts = np.where(places > begin[places], ids[np.maximum(places - 1, 0)], 0)
    spans: dict[tuple[int, int], int] = {}
    maximal_pairs(places.tolist(), lcp[kept].tolist(), lefts.tolist(), least, spans)
    if spans:
        table = np.array([(s, e - s, q) for (s, e), q in spans.items()])
        table = table[np.lexsort((table[:, 2], table[:, 0]))]
        of = doc[table[:, 0]]
        table[:, 0] -= begin[table[:, 0]]
        for d, run in zip(of.tolist(), table.tolist(), strict=True):
            found[d].append(tuple(run))
    return found


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def collapse(docs: DataFrame, least: int = LEAST, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs and the text without repeated periods (words joined by one space) of each document.

    ``rewrite(doc_id, n)``, if given, returns which original word stands at each place (None: all stay).
    """
    prepare(docs.sparkSession)
    shallow = (least + 1) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, waiting, held = Numbers(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, held
            arrays = [x[2] for x in waiting if x[2] is not None]
            found = iter(find(np.concatenate([np.empty(0, np.int64), *arrays]), np.array([len(a) for a in arrays], np.int64), least))
            ids, counts, runs, texts = [], [], [], []
            for doc_id, words, array in waiting:
                own = next(found) if array is not None else []
                if own:
                    gone = dropped(own, len(words))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    counts.append(len(gone))
                else:
                    counts.append(len(words))
                ids.append(doc_id)
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                texts.append(b" ".join(words))
            waiting, held = [], 0
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, kind), pc.cast(pa.array(texts, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (data or b"").split()  # at space and 0x09 to 0x0D
                if len(numbers) > MEMORY_WORDS and not held:
                    numbers = Numbers()
                at = rewrite(doc_id, len(words)) if rewrite else None
                if at is not None:
                    words = [words[i] for i in at.tolist()]
                array = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                if not has_repeat(array, shallow):
                    array = None
                waiting.append((doc_id, words, array))
                held += len(words)
                if held >= BATCH_WORDS:
                    yield flush()
        if waiting:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(work, RUNS)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document of ``n`` words: one document in ten ends periodically."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g, rest = divmod(h, 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def report(found: DataFrame) -> DataFrame:
    """The longest run of each document and digests of all its runs and of its text without repeats."""
    best = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.sign(y["length"] - x["length"])).when(x["start"] != y["start"], F.sign(x["start"] - y["start"])).otherwise(F.sign(x["period"] - y["period"])).cast("int"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    first = F.get(best, F.lit(0))
    out = found.withColumn("_first", first)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_first.start").alias("start"), F.col("_first.length").alias("length"), F.col("_first.period").alias("period"),
        F.expr("(1000 * _first.length) div _first.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
