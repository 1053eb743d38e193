"""Token-id files under Re-Pair grammar compression.

Texts are encoded and cut into shards in ascending id order. In each shard, rounds replace the frequent
pairs of adjacent symbols by new nonterminals, until no pair is frequent; no pair spans two documents.
A shard stores
its rules, the expansion length of each rule, where each document's symbols begin, and the symbols,
so one document, or a range of its ids, is decoded by the rules below its symbols alone.

Shards are rows of a Parquet table (binary payloads), so Spark's commit protocol covers them: a task
that is lost and run again leaves no half-written file.

Cases: null and empty texts give the end id alone; repeated doc_ids are separate documents, in the
order of a hash of their texts; null doc_ids come first; an empty table gives an empty table of files; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import keep, prepare
from tideframe.llm.tokens import encoder, gathered, tokenizer_path

MAGIC = b"RPR1"
SHARD_TOKENS = 2_000_000
#: A pair seen so often in a shard gets a rule, if overlaps with more frequent pairs leave it so many uses.
LEAST_COUNT = 16
LEAST_USES = 8
#: Text of a task: finer while a corpus has few tasks, coarser beyond; shards are cut inside.
FINE_BYTES, COARSE_BYTES, FINE_BLOCKS = 8 << 20, 256 << 20, 4096
#: Blocks whose sizes are summed together.
_STRIDE = 1024
SHARD_SCHEMA = "block int, seq int, doc_ids array<long>, n_tokens long, payload binary"


def _chosen(place: np.ndarray) -> np.ndarray:
    """Where pairs are replaced. ``place``: the rank of the pair at each place, -1 for none.

    Of overlapping pairs the more frequent goes first; of equal ones the left. A second pass chooses
    from what the first leaves free.
    """
    wins = np.zeros(len(place) + 1, bool)
    at = np.flatnonzero(place >= 0)
    for again in (True, False):
        rank = place[at]
        before = np.append(False, at[1:] == at[:-1] + 1)
        after = np.append(before[1:], False)
        won = ~(before & (np.append(0, rank[:-1]) <= rank)) & ~(after & (np.append(rank[1:], 0) < rank))
        wins[at[won]] = True
        if again:
            rest = at[~won]
            at = rest[~(wins[rest - 1] | wins[rest + 1])]
            if not len(at):
                break
    return np.flatnonzero(wins)


def compress(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs) and last symbol positions of the documents.

    ``ids``: ids of all documents, one after another; ``ends``: position of each document's last id;
    ``first``: the first free symbol, above all ids. Each round replaces all pairs seen ``LEAST_COUNT``
    times or more, most frequent first. Counts of pairs only fall, so later rounds look just at pairs
    with a new symbol; they go on until no pair is frequent.
    """
    symbols, rules = ids.astype(np.uint32, copy=True), np.empty((0, 2), np.uint32)
    ends = ends.astype(np.int64)
    fresh = np.ones(len(symbols), bool)  # symbols whose pairs may have become frequent
    while len(symbols) > 1:
        inside = fresh[:-1] | fresh[1:]
        inside[ends[:-1]] = False
        at = np.flatnonzero(inside)
        if len(at) < LEAST_COUNT:
            break
        left, right = symbols[at].astype(np.uint64), symbols[at + 1].astype(np.uint64)
        bits = np.uint64(len(symbols).bit_length())
        width = np.uint64(int(first + len(rules)).bit_length())
        if int(bits + width + width) <= 64:  # place below pair: one sort of plain numbers
            ordered = np.sort((left << width | right) << bits | at.astype(np.uint64))
            pair, at = ordered >> bits, (ordered & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        else:
            pair = left << np.uint64(32) | right
            width = np.uint64(32)
            order = np.argsort(pair, kind="stable")
            pair, at = pair[order], at[order]
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        counts = np.diff(np.append(starts, len(pair)))
        often = counts >= LEAST_COUNT
        if not often.any():
            break
        found = np.flatnonzero(often)
        found = found[np.argsort(-counts[found], kind="stable")]  # most frequent first, then by symbols
        rank = np.full(len(counts), -1, np.int64)
        rank[found] = np.arange(len(found))
        rank = np.repeat(rank, counts)
        some = rank >= 0
        place = np.full(len(symbols), -1, np.int32)  # back in the order of places
        place[at[some]] = rank[some]
        at = _chosen(place)
        rank = place[at]
        uses = np.bincount(rank, minlength=len(found))
        kept = uses >= LEAST_USES  # a rule that overlaps leave too few uses is not worth its room
        if not kept.any():
            break
        number = np.cumsum(kept) - 1
        stays = kept[rank]
        at, rank = at[stays], number[rank[stays]]
        pairs = pair[starts[found[kept]]]
        low = np.uint64((1 << int(width)) - 1)
        symbols[at] = (first + len(rules) + rank).astype(np.uint32)
        fresh = np.zeros(len(symbols), bool)
        fresh[at] = True
        alive = np.ones(len(symbols), bool)
        alive[at + 1] = False
        ends = np.cumsum(alive)[ends] - 1
        symbols, fresh = symbols[alive], fresh[alive]
        rules = np.concatenate([rules, np.stack([pairs >> width, pairs & low], 1).astype(np.uint32)])
    return symbols, rules, ends


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids below each rule; a rule names only ids and earlier rules."""
    lengths = np.ones(len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[k] = (lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1)
    return lengths


def pack(symbols: np.ndarray, rules: np.ndarray, ends: np.ndarray, first: int) -> bytes:
    """Symbols are stored as their low 16 bits, then, where any has more, the rest of them in one byte each."""
    top = first + len(rules)
    if top > 1 << 24:
        raise ValueError("symbols of a shard must fit 24 bits")
    high = top > 1 << 16
    head = MAGIC + struct.pack("<5I", first, len(rules), len(ends), len(symbols), high)
    parts = [rules.astype("<u4"), expansion_lengths(rules, first).astype("<u4"), (ends + 1).astype("<u4"), (symbols & np.uint32(0xFFFF)).astype("<u2")]
    if high:
        parts.append((symbols >> np.uint32(16)).astype(np.uint8))
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A packed shard, opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a Re-Pair shard")
        self.first, n_rules, n_docs, n_symbols, high = struct.unpack_from("<5I", payload, 4)
        at = 24
        self.rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(payload, "<u4", n_rules, at)
        at += 4 * n_rules
        self.ends = np.frombuffer(payload, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.symbols = np.frombuffer(payload, "<u2", n_symbols, at).astype(np.uint32)
        if high:
            self.symbols |= np.frombuffer(payload, np.uint8, n_symbols, at + 2 * n_symbols).astype(np.uint32) << np.uint32(16)

    def __len__(self) -> int:
        return len(self.ends)

    def _symbols(self, doc: int) -> np.ndarray:
        return self.symbols[self.ends[doc - 1] if doc else 0 : self.ends[doc]]

    @functools.cached_property
    def _rule_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """Expansions of all rules in a row, and where each begins; rules name only earlier ones."""
        begin = np.cumsum(self.lengths.astype(np.int64)) - self.lengths
        out, done = np.empty(int(self.lengths.sum()), np.uint32), []
        for a, b in self.rules.tolist():
            done.append((done[a - self.first] if a >= self.first else [a]) + (done[b - self.first] if b >= self.first else [b]))
        for at, ids in zip(begin.tolist(), done, strict=True):
            out[at : at + len(ids)] = ids
        return out, begin

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        ids, begin = self._rule_ids
        symbols = symbols.astype(np.int64)
        inner = np.flatnonzero(symbols >= self.first)
        rule = symbols[inner] - self.first
        size = np.ones(len(symbols), np.int64)
        size[inner] = self.lengths[rule]
        start = np.cumsum(size) - size
        out = np.repeat(symbols.astype(np.uint32), size)
        length = size[inner]
        within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(start[inner], length) + within] = ids[np.repeat(begin[rule], length) + within]
        return out

    def _descend(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols by the rules below them alone, a level of the grammar at a time."""
        while (inner := symbols >= self.first).any():
            size = np.where(inner, 2, 1)
            start = (np.cumsum(size) - size)[inner]
            pairs = self.rules[symbols[inner] - self.first]
            symbols = np.repeat(symbols, size)
            symbols[start], symbols[start + 1] = pairs[:, 0], pairs[:, 1]
        return symbols

    def document(self, doc: int) -> np.ndarray:
        """All ids of one document."""
        return self._descend(self._symbols(doc))

    def token_range(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of one document; only the symbols that cover them are expanded."""
        symbols = self._symbols(doc)
        size = np.ones(len(symbols), np.int64)
        inner = symbols >= self.first
        size[inner] = self.lengths[symbols[inner] - self.first]
        reach = np.cumsum(size)
        a, b = np.searchsorted(reach, start, "right"), np.searchsorted(reach, stop, "left") + 1
        skipped = int(reach[a - 1]) if a else 0
        return self._descend(symbols[a:b])[start - skipped : stop - skipped]

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in turn; the shard is expanded once."""
        inner = self.symbols >= self.first
        size = np.ones(len(self.symbols), np.int64)
        size[inner] = self.lengths[self.symbols[inner].astype(np.int64) - self.first]
        reach = np.append(0, np.cumsum(size))[np.append(0, self.ends)]
        ids = self._expand(self.symbols)
        for a, b in zip(reach[:-1].tolist(), reach[1:].tolist(), strict=True):
            yield ids[a:b]


def write_shards(docs: DataFrame, path: str | None = None, name: str = "token-files") -> DataFrame:
    """Encode ``docs`` and write the shards to the shared folder; returns the table of files, read back.

    Documents are dealt by ranges of (doc_id, hash of the text), so that rows of one id, or without an id,
    are dealt out too. ``path``: the tokenizer's file; every worker opens it, so it must be at the same
    place on all.
    """
    prepare(docs.sparkSession)
    path = path or tokenizer_path()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, min(size // FINE_BYTES, FINE_BLOCKS), size // COARSE_BYTES)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        first = enc.tokenizer.get_vocab_size()
        seq, doc_ids, parts, n, block = 0, [], [], 0, None

        def shard() -> pa.RecordBatch:
            stops = np.cumsum([len(p) for p in parts])
            payload = pack(*compress(np.concatenate(parts), stops - 1, first), first)
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([seq], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([payload], pa.binary())],
                names=["block", "seq", "doc_ids", "n_tokens", "payload"],
            )

        for batch in gathered(batches):
            block = batch.column(0)[0].as_py()  # a task has one block
            for doc, ids in zip(batch.column(1).to_pylist(), enc.each(batch.column(2)), strict=True):
                if n >= SHARD_TOKENS:
                    yield shard()
                    seq, doc_ids, parts, n = seq + 1, [], [], 0
                doc_ids.append(doc)
                parts.append(ids)
                n += len(ids)
        if parts:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    placed = rows.repartitionByRange(blocks, F.asc_nulls_first("doc_id"), "tie").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text")
    return keep(placed.select(F.spark_partition_id().alias("block"), "doc_id", "text").mapInArrow(encode, SHARD_SCHEMA), name)


def read_documents(files: DataFrame) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32, shard, place in it."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, out = row["start"], []
                for ids in Shard(row["payload"]).documents():
                    out.append((start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                n = len(out)
                columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), *columns, pa.array([row["block"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32()), pa.array(range(n), pa.int32())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "block", "seq", "place"],
                )

    sizes = files.groupBy("block", "seq").agg(F.sum("n_tokens").alias("n"))
    # what lies before a block: whole strides of blocks, then blocks of its own stride
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n")).withColumn("stride", F.expr(f"block div {_STRIDE}"))
    strides = blocks.groupBy("stride").agg(F.sum("n").alias("whole"))
    above = Window.orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)  # a row for each 8 to 256 GB of text
    strides = strides.select("stride", F.coalesce(F.sum("whole").over(above), F.lit(0)).alias("whole"))
    before = Window.partitionBy("stride").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("own", F.coalesce(F.sum("n").over(before), F.lit(0))).join(strides, "stride")
    blocks = blocks.select("block", (F.col("whole") + F.col("own")).alias("base"))
    inside = Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    starts = sizes.join(blocks, "block").select("block", "seq", (F.col("base") + F.col("inner")).alias("start"))
    placed = files.join(starts, ["block", "seq"]).select("block", "seq", "doc_ids", "payload", "start")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, block int, seq int, place int"
    return placed.mapInArrow(decode, schema)
