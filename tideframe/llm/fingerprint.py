"""Document fingerprints: one-permutation MinHash with optimal densification, b bits a bin.

Each five-word shingle is hashed once; the high bits choose one of ``BINS`` bins, the least value stays.
An empty bin borrows from a full one that a sequence of random draws, fixed for the bin, hits first;
the draws don't depend on the text, so texts of one shingle set have one fingerprint. The low ``BITS``
bits of each bin are stored packed; the share of equal bins is corrected for chance agreement.

Cases: null and empty texts, and texts without words, have the empty fingerprint, alike (1.0) among
themselves and unlike (0.0) all others; equal texts have equal fingerprints; rows of one doc_id are
neighbours in the order of their texts; null doc_ids come last; a table of one row neighbours itself;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import block_of, id_bounds, prepare
from tideframe.llm.shingles import mix, shingle_hashes

BINS = 512
BITS = 4
ROWS_A_BLOCK = 1_000
_DRAWS = np.random.default_rng(7).integers(0, BINS, (BINS, 4096), np.int16)

_BIN_SALT = np.random.default_rng(11).integers(0, 1 << 63, BINS, np.uint64)


def bins(hashes: np.ndarray) -> np.ndarray:
    """The densified bin values of ascending shingle hashes."""
    shift = np.uint64(64 - (BINS - 1).bit_length())
    place = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    full = np.zeros(BINS, bool)
    value = np.zeros(BINS, np.uint64)
    full[place[first]] = True
    value[place[first]] = hashes[first]
    empty = np.flatnonzero(~full)
    lo, width = 0, 8
    while len(empty) and lo < _DRAWS.shape[1]:
        draws = _DRAWS[empty, lo : lo + width]
        hits = full[draws]
        some = hits.any(axis=1)
        value[empty[some]] = value[draws[some, hits[some].argmax(axis=1)]]
        empty, lo, width = empty[~some], lo + width, 256
    if len(empty):  # all 4096 draws missed: walk on
        held = np.flatnonzero(full)
        value[empty] = value[held[np.searchsorted(held, empty) % len(held)]]
    return value


def low_bits(hashes: np.ndarray) -> np.ndarray | None:
    """Low bits of each bin's value, mixed with the bin first: a value lent to many bins gives each other bits."""
    return (mix(bins(hashes) + _BIN_SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8) if len(hashes) else None


def packed(low: np.ndarray | None) -> str:
    if low is None:
        return ""
    spread = np.unpackbits(low[:, None], axis=1)[:, 8 - BITS :]
    return np.packbits(spread.ravel()).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity: equal bins, less the share that chance makes equal."""
    if a is None or b is None:
        return 1.0 if a is None and b is None else 0.0
    chance = 0.5**BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's, descending doc_id."""
    spark = prepare(docs.sparkSession)
    blocks = max(1, docs.count() // ROWS_A_BLOCK)
    bounds = id_bounds(docs, "doc_id", blocks)
    # Block 0 has the largest ids. Each block also gets the first rows of the block after it.
    block = F.lit(len(bounds)) - block_of(F.col("doc_id"), bounds)
    tops = docs.select("doc_id", block.alias("b")).groupBy("b").agg(F.max("doc_id").alias("top")).orderBy("b").collect()
    before = {tops[i]["b"]: tops[i - 1]["b"] for i in range(len(tops))}
    lent = spark.createDataFrame([(t["b"], t["top"], before[t["b"]]) for t in tops], "b int, top long, lent int")
    placed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), block.cast("int").alias("b"))
    own = placed.join(F.broadcast(lent), "b")  # a row for each block
    to = F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("guest")))
    guest = F.array(F.struct(F.col("lent").alias("b"), F.lit(1).alias("guest")))
    to = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.concat(to, guest)).otherwise(to)
    dealt = own.select("doc_id", "text", F.explode(to).alias("at")).select("at.b", "at.guest", "doc_id", "text")
    dealt = dealt.repartition(len(bounds) + 1, "b").sortWithinPartitions("b", "guest", F.desc_nulls_last("doc_id"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last, done = None, False  # the row that waits for its next one: (block, doc_id, text, bits)
        out: list[tuple] = []
        for batch in batches:
            for b, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and last[0] != b:
                    last, done = None, False
                if done:
                    continue
                low = low_bits(shingle_hashes(text))
                if last is not None:
                    new = edited(last[2], text)
                    new_low = low_bits(shingle_hashes(new))
                    out.append((last[1], len(last[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), packed(last[3]), packed(new_low), likeness(last[3], new_low), likeness(last[3], low)))
                last, done = (b, doc, text, low), bool(guest)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)
            out = []

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(sign, schema)
