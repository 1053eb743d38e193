"""Exact substring dedup by suffix order and longest-previous-factor matches.

A byte goes when it is covered by a string of ``length`` bytes that also starts elsewhere, in the same
or another document; overlaps count, and all is judged on the input. ``keep="first"`` leaves the first
copy (by doc_id, then place) of each such string alone, ``keep="none"`` removes all copies.

Bringing equal strings together: in every window of ``length`` bytes the gram of least hash is its
anchor, so equal windows have equal anchors at equal places. Windows of one anchor that follow each
other are a run; a run whose anchor occurs nowhere else has no repeat. The bytes of all other runs (each
content once, or twice where it has copies: a third copy adds nothing) go to suffix-array blocks, whole
anchors to a block.

Deciding: a block sorts the suffixes at its windows by their first ``length`` bytes (prefix doubling over
ranks), ties by place in document order; common prefixes below ``length`` are of no use and count as 0.
The previous and next smaller places in suffix order then give the longest previous factor of each
window, the previous and next larger ones its longest next factor. A window with a previous factor of
``length`` is a later copy; one with either is repeated.

Skew: an anchor of 100 bytes that many different contents share (a common passage in many surroundings)
may exceed a block. Its runs are anchored again by longer grams, up to grams of the whole window, where
a run is one window and all contents of an anchor are equal. So no block outgrows ``BLOCK_BYTES`` by
more than one anchor's, and all anchors end in suffix-array blocks.

Cases: null texts are empty; texts shorter than ``length`` keep all; rows of one doc_id are separate
documents told apart by their texts; rows equal in doc_id and text are copies of each other, and
``keep="first"`` treats them as one; null doc_ids come first; cuts may split a UTF-8 character, so what
is kept is binary; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import forget, keep, partitions, prepare
from tideframe.llm.shingles import mix

LENGTH = 400
GRAM = 100
BLOCK_BYTES = 1 << 20
#: Gram lengths from the first to the whole window.
LEVELS = 4
_PIECE = 1 << 20
_ODD = 0xBF58476D1CE4E5B9
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64)
_ID = ["hi", "lo"]


class _Powers:
    """Powers of an odd number and of its inverse, as many as asked for so far."""

    power = inverse = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.power) < n:
            size = 1 << (n - 1).bit_length()
            ones = np.ones(1, np.uint64)
            cls.power = np.append(ones, np.cumprod(np.full(size - 1, _ODD, np.uint64), dtype=np.uint64))
            cls.inverse = np.append(ones, np.cumprod(np.full(size - 1, pow(_ODD, -1, 1 << 64), np.uint64), dtype=np.uint64))
        return cls.power[:n], cls.inverse[:n]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram; equal grams have equal hashes."""
    power, inverse = _Powers.of(len(raw))
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power, dtype=np.uint64))
    return mix((sums[gram:] - sums[:-gram]) * inverse[: len(raw) - gram + 1])


def runs(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each run of windows with one anchor."""
    hashes = gram_hashes(raw, gram)
    width = length - gram + 1
    place = np.uint64(0xFFFFFF)  # hash above, place below: of equal hashes the leftmost is least
    key = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    short = -len(key) % width
    padded = np.append(key, np.full(short, ~np.uint64(0), np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(hashes) - width + 1
    anchor = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & place).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return first, np.diff(np.append(first, n)), hashes[anchor[first]]


def ranks(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of each start by its first ``length`` bytes in suffix order; equal prefixes share a rank.

    Prefix doubling: the rank of 2k bytes comes from the ranks of k bytes here and k bytes on.
    """
    n = len(text)
    bits = n.bit_length()

    def dense(key: np.ndarray) -> np.ndarray:
        if 3 * bits > 64:
            return np.unique(key, return_inverse=True)[1].astype(np.uint64)
        # two ranks and a place fit a number: plain numbers are sorted
        ordered = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
        at, key = (ordered & np.uint64((1 << bits) - 1)).astype(np.int64), ordered >> np.uint64(bits)
        rank = np.empty(len(key), np.uint64)
        rank[at] = np.cumsum(np.append(False, key[1:] != key[:-1]))
        return rank

    have = min(length, max(1, 2 * bits // 8))
    padded = np.append(text, np.zeros(have, np.uint8)).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(have):
        word = word << np.uint64(8) | padded[k : k + n]
    if have == length:
        return dense(word[starts])
    rank = dense(word)
    while True:
        step = min(have, length - have)
        last = have + step == length
        at = starts if last else np.arange(n)
        rank = dense(rank[at] << np.uint64(bits) | rank[np.minimum(at + step, n - 1)])
        if last:
            return rank
        have += step


def nearest_smaller(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in suffix order, the nearest one before it of a smaller place, and their common prefix.

    ``lcp[i]``: common prefix of suffixes i - 1 and i; the search ends where it is 0 (-1, 0 then). A suffix
    jumps to where the one it looked at has jumped to: all between have larger places.
    """
    jump, reach = np.arange(-1, len(place) - 1), lcp.copy()
    reach[:1] = 0
    at = np.flatnonzero(reach > 0)
    at = at[place[jump[at]] > place[at]]
    while len(at):
        on = jump[at]
        reach[at] = np.minimum(reach[at], reach[on])
        jump[at] = jump[on]
        at = at[reach[at] > 0]
        at = at[place[jump[at]] > place[at]]
    jump[reach == 0] = -1
    return jump, reach


def longest_factors(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of each suffix, in suffix order.

    The longest match at a smaller place is that of the previous or of the next smaller place in suffix
    order; at a larger place likewise.
    """
    back = np.append(lcp[:0], np.append(0, lcp[:0:-1])) if len(lcp) else lcp
    found = []
    for p in (place, -place):
        before = nearest_smaller(p, lcp)[1]
        after = nearest_smaller(p[::-1], back)[1][::-1]
        found.append(np.maximum(before, after))
    return found[0], found[1]


def _intervals(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2].tolist(), edge[1::2].tolist()


def _factors(texts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the windows of each context, in document order: whether one is elsewhere, whether it is earlier."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    n = sizes - length + 1
    first = np.cumsum(sizes) - sizes
    starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    rank = ranks(text, starts, length)
    order = np.argsort(rank, kind="stable")
    sorted_ = rank[order]
    lcp = np.where(np.append(False, sorted_[1:] == sorted_[:-1]), length, 0)
    previous, next_ = longest_factors(order, lcp)
    earlier, elsewhere = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[order] = previous >= length
    elsewhere[order] = np.maximum(previous, next_) >= length
    cuts = np.cumsum(n)[:-1]
    return list(zip(np.split(elsewhere, cuts), np.split(earlier, cuts), strict=True))


def _level(length: int, gram: int, level: int) -> int:
    return gram + (length - gram) * level // (LEVELS - 1)


def _anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of ``texts(doc_id, tie, text, parts)``: of the windows in parts (arrays of (a, n)), or of all windows."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, firsts, counts, hashes, digests = [], [], [], [], [], []
            for doc, tie, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                raw = np.frombuffer(data, np.uint8)
                for begin, many in [(0, len(raw) - length + 1)] if parts is None else [(p["a"], p["n"]) for p in parts]:
                    for lo in range(begin, begin + many, _PIECE):
                        first, n, h = runs(raw[lo : min(lo + _PIECE, begin + many) + length - 1], length, gram)
                        first = first + lo
                        for a, k in zip(first.tolist(), n.tolist(), strict=True):
                            digests.append(hashlib.blake2b(data[a : a + k + length - 1], digest_size=16).digest())
                        ids += [doc] * len(first)
                        ties += [tie] * len(first)
                        firsts.append(first)
                        counts.append(n)
                        hashes.append(h)
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            flat = [np.concatenate([np.empty(0, t), *x]).astype(t) for x, t in ((firsts, np.int32), (counts, np.int32))]
            anchor = np.concatenate([np.empty(0, np.uint64), *hashes]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(flat[0]), pa.array(flat[1])],
                names=["anchor", "hi", "lo", "doc_id", "tie", "a", "n"],
            )

    return texts.select("doc_id", "tie", "text", "parts").mapInArrow(anchors, "anchor long, hi long, lo long, doc_id long, tie long, a int, n int")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """A stored step; its shuffle files, which hold the runs or the contents again, go with it."""
    return keep(df, name, tidy=True)


_PARTS = "array<struct<a:int,n:int>>"


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none") -> DataFrame:
    """doc_id, tie, spans: arrays of (start, stop) bytes to remove, unmerged, for documents that have some."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").where(F.octet_length("text") >= length)
    looked, spans = texts.withColumn("parts", F.lit(None).cast(_PARTS)), None
    for level in range(LEVELS):
        found = kept_table(_anchored(looked, length, _level(length, gram, level)), "runs")
        # A table of its own, so that the join below reads plain rows and a hot anchor's can be split.
        seen = kept_table(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor"), "repeated-anchors")
        again = kept_table(found.join(seen, "anchor"), "repeated-runs")
        forget(found)
        place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie", "a")
        contents = again.groupBy("anchor", "hi", "lo").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("first"), F.first("n").alias("n"))
        contents = kept_table(contents, "contents")
        hot = contents.groupBy("anchor").agg(F.sum((F.col("n") + (length - 1)) * F.least("m", F.lit(2))).alias("load"))
        hot = kept_table(hot.where((F.col("load") > BLOCK_BYTES) & F.lit(level < LEVELS - 1)).select("anchor"), "hot-anchors")
        more = not hot.isEmpty()
        small = contents.join(hot, "anchor", "left_anti") if more else contents
        contexts = _contexts(texts, small, length)
        forget(contents)
        results = _blocks(contexts, length)
        part = _spans(again, results, length, keep)
        spans = part if spans is None else spans.unionByName(part)
        if not more:
            break
        parts = again.join(hot, "anchor", "left_semi").select("doc_id", "tie", "a", "n").distinct()
        parts = parts.groupBy(F.col("doc_id").alias("doc"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("a", "n")).alias("parts"))
        looked = texts.join(parts, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("tie") == F.col("t"))).select("doc_id", "tie", "text", "parts")
    return spans.groupBy("doc_id", "tie").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _contexts(texts: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """The bytes of each content, from where it is first: anchor, hi, lo, m, doc_id, tie, a, n, bytes; kept."""
    by_doc = contents.groupBy(F.col("first.doc_id").alias("doc"), F.col("first.tie").alias("t")).agg(F.collect_list(F.struct("anchor", "hi", "lo", "m", F.col("first.a").alias("a"), "n")).alias("parts"))
    on = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("tie") == F.col("t"))
    cut = texts.join(by_doc, on).select("doc_id", "tie", F.encode("text", "utf-8").alias("raw"), F.explode("parts").alias("p"))
    cut = cut.select("p.*", "doc_id", "tie", F.expr(f"substring(raw, p.a + 1, p.n + {length - 1})").alias("bytes"))
    # rows equal in doc_id and text give a content twice: one is enough
    return kept_table(cut.dropDuplicates(["anchor", "hi", "lo"]), "contexts")


def _spans(again: DataFrame, results: DataFrame, length: int, keep: str) -> DataFrame:
    """doc_id, tie, spans of the runs whose contents are in ``results``."""
    joined = again.select("hi", "lo", "doc_id", "tie", "a").join(results, _ID)
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")) & (F.col("a") == F.col("first.a"))
    spans = F.when(is_first, F.col("late")).otherwise(F.col("all")) if keep == "first" else F.col("all")
    moved = F.transform(spans, lambda x: F.struct((F.col("a") + x["s"]).alias("s"), (F.col("a") + x["e"] + (length - 1)).alias("e")))
    return joined.select("doc_id", "tie", moved.alias("spans")).where(F.size("spans") > 0)


_RESULT = "hi long, lo long, first struct<has:boolean,doc_id:bigint,tie:bigint,a:int>, all array<struct<s:int,e:int>>, late array<struct<s:int,e:int>>"


def _blocks(contexts: DataFrame, length: int) -> DataFrame:
    """hi, lo, first (place), all, late: windows of each content that are elsewhere, that are earlier; a block at a time."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            out, copies = [], [r for r in held for _ in range(min(r["m"], 2))]
            last = None
            for row, (elsewhere, earlier) in zip(copies, _factors([r["bytes"] for r in copies], length), strict=True):
                if row is last:  # the copy, of which all is earlier
                    continue
                last = row
                spans = [[{"s": s, "e": e} for s, e in zip(*_intervals(x), strict=True)] for x in (elsewhere, earlier)]
                first = {"has": row["doc_id"] is not None, "doc_id": row["doc_id"], "tie": row["tie"], "a": row["a"]}
                out.append({"hi": row["hi"], "lo": row["lo"], "first": first, "all": spans[0], "late": spans[1]})
            pair = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
            first = pa.struct([("has", pa.bool_()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("a", pa.int32())])
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("first", first), ("all", pair), ("late", pair)]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["anchor"] != last and size >= BLOCK_BYTES:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row["bytes"]) * min(row["m"], 2), row["anchor"]
        if held:
            yield done()

    placed = contexts.repartition(partitions(contexts.sparkSession), "anchor").sortWithinPartitions("anchor", "doc_id", "tie", "a")
    return placed.mapInArrow(sort, _RESULT)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (maximal removed runs), kept (binary) of each row."""
    if keep not in ("none", "first"):
        raise ValueError("keep must be 'none' or 'first'")
    prepare(docs.sparkSession)
    gone = repeats(docs, length, gram, keep).withColumnRenamed("doc_id", "_id").withColumnRenamed("tie", "_tie")
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, sizes = [], [], []
            texts, lists = batch.column(1).to_pylist(), batch.column(2)
            ends = lists.offsets.to_numpy()
            flat = lists.values
            s_all, e_all = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("s", "e"))
            for i, text in enumerate(texts):
                data = text.encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                lo, hi = ends[i], ends[i + 1]
                if lo == hi:
                    kept.append(data)
                    spans.append([])
                    continue
                order = np.argsort(s_all[lo:hi], kind="stable")
                s, e = s_all[lo:hi][order], np.maximum.accumulate(e_all[lo:hi][order])
                new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                begin, stop = s[new].tolist(), e[np.append(new[1:], len(s)) - 1].tolist()
                parts = [data[a:b] for a, b in zip([0, *stop], [*begin, len(data)], strict=True)]
                kept.append(b"".join(parts))
                spans.append([{"start": a, "stop": b} for a, b in zip(begin, stop, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            removed = [n - len(k) for n, k in zip(sizes, kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    empty = F.array().cast("array<struct<s:int,e:int>>")
    joined = joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("spans", empty).alias("spans"))
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,stop:bigint>>, kept binary")
