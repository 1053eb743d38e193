"""Exact Jaccard join of shingle sets by token-combination prefixes.

Two documents link when their sets of five-word shingles have a similarity of at least ``threshold``
percent. Sets are ordered: rare shingles first (by hash), then frequent ones (by how many documents
have them). A set of n shingles that links shares one of its first p = n - ceil(t n) + 1 with its
partner. Where these are all rare they are indexed singly. Where rare ones don't fill the prefix, all
rare ones are indexed, and the frequent part is extended and indexed by combinations of two
neighbouring shingles: if no rare shingle is shared, at most m_x and m_y frequent ones differ, so of
the first m_x + m_y + 2 shared shingles two follow each other in both sets.

Documents of one set are one class from the start. In each index bucket the pairs that a 512-bit
parity sketch cannot rule out (its Hamming distance never exceeds the sets' difference) are joined by
a spanning forest, nearest first; its edges are verified on the sets and make components. A second
pass takes, in buckets that still hold several components, every pair across components that the
sketch leaves, so no link between components is lost. Buckets are dealt out in chunks: no task gets a
bucket whole, and a class or component is never expanded into all its pairs.

Large buckets of the second pass are split by length first. Two sets that meet by a combination and
share no rare shingle (others meet by that one) share at most their frequent ones, so the longer needs
a shorter partner within bounds that its own counts give, and a set with more than (1 - t) / (1 + t)
rare ones is no such partner. Documents of one template that differ by too much to link meet nowhere.

Cases: documents without words (null, empty, blank) have the empty set and link with nothing; with
fewer than five words the whole sequence is the one shingle; rows are told apart even where they share
a doc_id; rows with a null doc_id link with nothing and have a null component; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import components, keep, partitions, prepare
from tideframe.llm.shingles import SIZE, mix, shingle_hashes

THRESHOLD = 80
#: Shingles in this share of all documents, or in so many documents, are frequent, so that no bucket of a
#: rare one grows with the corpus; at most FREQUENT_MOST of them (8 MB), the most frequent.
FREQUENT_SHARE = 0.001
FREQUENT_COUNT = 1_000
FREQUENT_MOST = 500_000
BUCKET_ROWS = 1024
#: Shingles that a counting task holds at once.
COUNTED = 1 << 20
#: Lengths of one cell are within this factor, so that the lengths that link with one lie in few cells.
CELL_FACTOR = 1.12
_SKETCH_WORDS = 8
_LOW = (1 << 64) - 1
_SMALL = 32


def frequent_shingles(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """Hashes of frequent shingles, least frequent first: an order for the prefixes, not a filter.

    Tasks count all their documents, in buffers, and pass on what may be frequent; Spark sums.
    """
    total = docs.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, rows = [], 0, 0

        def flush() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            some = times >= max(3, min(FREQUENT_SHARE * rows, FREQUENT_COUNT))
            return pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(times[some])], names=["h", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(shingle_hashes(text, size))
                n, rows = n + len(held[-1]), rows + 1
            if n >= COUNTED:
                yield flush()
                held, n, rows = [], 0, 0
        if held:
            yield flush()

    sums = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = sums.where(F.col("n") >= max(16, min(FREQUENT_SHARE * total, FREQUENT_COUNT))).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).toArrow()
    h, n = (most.column(c).to_numpy() for c in ("h", "n"))
    return h[np.lexsort((~h, n))].view(np.uint64)


def index_keys(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The index keys of one set. ``frequent``: ascending hashes; ``rank``: their places in the order."""
    return np.concatenate(prefix_keys(hashes, frequent, rank, threshold))


def prefix_keys(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """The keys that are rare shingles, and those that are combinations: if any, the first are all rare ones of the set."""
    n = len(hashes)
    prefix = n - -(-threshold * n // 100) + 1
    if len(frequent):
        slot = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        often = frequent[slot] == hashes
    else:
        often = np.zeros(n, bool)
    rare = hashes[~often]
    if len(rare) >= prefix:
        return rare[:prefix], rare[:0]
    common = hashes[often][np.argsort(rank[slot[often]])]
    mine, other = prefix - 1 - len(rare), n * (100 - threshold) // threshold
    reach = common[: 2 * mine + other + 2]
    pairs = mix(reach[:-1] * np.uint64(0x9E3779B97F4A7C15) + reach[1:] + np.uint64(0x7F4A7C15))
    return rare, pairs


def sketch(hashes: np.ndarray) -> tuple[bytes, bytes]:
    """Parity of the set's counts in 512 cells, and in as many (a power of two) as it has members.

    Cells are the hash's low bits, so a wide sketch folds into a narrower one by exclusive or.
    """
    narrow = 64 * _SKETCH_WORDS
    cells = max(narrow, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    wide = np.packbits(odd)
    return np.bitwise_xor.reduce(wide.reshape(-1, narrow // 8), axis=0).tobytes(), wide.tobytes()


def signed(docs: DataFrame, size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """row, doc_id, tie (hash of the text), n, set_hi, set_lo (the set's hash), keys, singles (how many of these,
    the first, are rare shingles), sketch, wide of each row; kept.
    """
    often = frequent_shingles(docs, size)
    order = np.argsort(often)
    frequent, rank = often[order], np.arange(len(often))[order]
    shared = docs.sparkSession.sparkContext.broadcast((frequent, rank))  # 8 MB at most

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shared.value
        for batch in batches:
            ns, his, los, keys, singles, sketches = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, size)
                hi, lo = _set_hash(hashes)
                ns.append(len(hashes))
                his.append(hi)
                los.append(lo)
                rare, pairs = prefix_keys(hashes, frequent, rank, threshold) if len(hashes) else (hashes, hashes)
                keys.append(np.concatenate([rare, pairs]).view(np.int64))
                singles.append(len(rare))
                sketches.append(sketch(hashes) if len(hashes) else (b"", b""))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *keys]))
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), lists, pa.array(singles, pa.int64()), *(pa.array([x[i] for x in sketches], pa.binary()) for i in range(2))],
                names=["doc_id", "tie", "n", "set_hi", "set_lo", "keys", "singles", "sketch", "wide"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    rows = rows.mapInArrow(sign, "doc_id long, tie long, n long, set_hi long, set_lo long, keys array<long>, singles long, sketch binary, wide binary")
    return keep(rows.withColumn("row", F.monotonically_increasing_id()), "signed")  # stored, so the number stays


def _set_hash(hashes: np.ndarray) -> list[int]:
    return np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), "<i8").tolist()


class _Bucket:
    """Members of one chunk of a bucket; how far each is, in units of the largest difference that links."""

    def __init__(self, n: np.ndarray, sketches: np.ndarray, threshold: int):
        self.n, self.sketches = n, sketches
        self.unit = (100 - threshold) / (100 + threshold)

    def far(self, i: int) -> np.ndarray:
        differ = np.bitwise_count(self.sketches ^ self.sketches[i]).sum(axis=1, dtype=np.int64)
        differ = np.maximum(differ, np.abs(self.n - self.n[i]))
        return differ / ((self.n + self.n[i]) * self.unit)

    def hopeless(self) -> bool:
        """Whether a small bucket has no pair that may link: that is so of most buckets."""
        if len(self.n) > _SMALL:
            return False
        differ = np.bitwise_count(self.sketches[:, None] ^ self.sketches).sum(axis=2, dtype=np.int64)
        most = (self.n[:, None] + self.n) * self.unit + 1e-6
        return int((differ <= most).sum()) == len(self.n)  # each with itself

    def forest(self) -> np.ndarray:
        """Edges of a least spanning forest over the pairs that may link (Prim)."""
        m = len(self.n)
        if self.hopeless():
            return np.empty((0, 2), np.int64)
        near, parent, out = np.full(m, np.inf), np.full(m, -1), np.ones(m, bool)
        edges, at = [], 0
        for _ in range(m):
            out[at] = False
            if parent[at] >= 0 and near[at] <= 1 + 1e-9:
                edges.append((at, int(parent[at])))
            far = self.far(at)
            closer = out & (far < near)
            near[closer], parent[closer] = far[closer], at
            if out.any():
                at = int(np.argmin(np.where(out, near, np.inf)))
                if not out[at]:
                    at = int(np.argmax(out))
        return np.array(edges, np.int64).reshape(-1, 2)

    def across(self, component: np.ndarray) -> np.ndarray:
        """All pairs across components that may link."""
        if self.hopeless():
            return np.empty((0, 2), np.int64)
        labels, sizes = np.unique(component, return_counts=True)
        main = labels[np.argmax(sizes)]
        edges = []
        for i in np.flatnonzero(component != main):
            hit = np.flatnonzero((self.far(i) <= 1 + 1e-9) & (component != component[i]))
            edges.append(np.stack([np.full(len(hit), i), hit], 1))
        return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def _pairs(placed: DataFrame, labelled: bool, threshold: int) -> DataFrame:
    """Distinct pairs (a < b) to verify, from rows (key, chunk, rep, n, sketch[, component])."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(table: pa.Table, ended: bool) -> tuple[np.ndarray, pa.Table]:
            """Pairs of the groups that are whole in the table, and the rows of the last, which may go on."""
            table = table.combine_chunks()
            key, chunk, rep, n = (table.column(c).to_numpy() for c in ("key", "chunk", "rep", "n"))
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(rep), _SKETCH_WORDS)
            component = table.column("component").to_numpy() if labelled else None
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist()]
            cuts += [len(rep)] if ended else []
            found = [np.empty((0, 2), np.int64)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    bucket = _Bucket(n[lo:hi], sketches[lo:hi], threshold)
                    edges = bucket.across(component[lo:hi]) if labelled else bucket.forest()
                    if len(edges):
                        found.append(rep[lo:hi][edges])
            return np.sort(np.concatenate(found), axis=1), table.slice(cuts[-1])

        def out(ends: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ends, rest = groups(table if rest is None else pa.concat_tables([rest, table]), False)
            yield out(ends)
        if rest is not None:
            yield out(groups(rest, True)[0])

    parts = placed.repartition(partitions(placed.sparkSession), "key", "chunk").sortWithinPartitions("key", "chunk")
    return parts.mapInArrow(pair, "a long, b long").where("a < b").distinct()


def _dealt(labelled: DataFrame, threshold: int) -> DataFrame:
    """Rows (key, chunk, rep, n, component) in which all pairs across components that may link meet.

    ``labelled``: key, size (of the bucket), rep, n, component, and shared: how many shingles at most two
    sets have in common that meet in this bucket and in no earlier one. Large buckets are split by cells
    of length: a row is in its own cell if a longer one may link with it, and in those of all shorter
    ones that may link with it. In each, the fewer of the rows outside the largest component and of
    those in their own cell meet all rows; both sides go in chunks.
    """

    def cell(length: Column) -> Column:
        return F.floor(F.log(length.cast("double")) / math.log(CELL_FACTOR))

    n, shared = F.col("n"), F.col("shared")
    shorter = shared * (100 + threshold) >= 2 * threshold * n
    least = F.floor((n * threshold + 99) / 100)
    most = F.least(n, F.floor(shared * (100 + threshold) / threshold) - n)
    of_shorter = F.when(most >= least, F.sequence(cell(least), cell(most))).otherwise(F.array().cast("array<bigint>"))
    cells = F.array_union(of_shorter, F.when(shorter, F.array(cell(n))).otherwise(F.array().cast("array<bigint>")))
    cells = F.when(F.col("size") > BUCKET_ROWS, cells).otherwise(F.array(F.lit(-1).cast("bigint")))
    rows = labelled.select("key", "rep", "n", "component", shorter.alias("shorter"), F.explode(cells).alias("cell"))
    rows = rows.withColumn("home", (F.col("cell") < 0) | (F.col("shorter") & (F.col("cell") == cell(n)))).drop("shorter")

    parts = rows.groupBy("key", "cell", "component").agg(F.count(F.lit(1)).alias("k"), F.count_if("home").alias("h"))
    mixed = parts.groupBy("key", "cell").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("all"), F.sum("h").alias("homes"))
    mixed = mixed.where((F.col("most") < F.col("all")) & (F.col("homes") > 0))
    by_home = F.col("homes") < F.col("all") - F.col("most")
    n_all, n_few = F.ceil(F.col("all") / BUCKET_ROWS).cast("int"), F.ceil(F.least("homes", F.col("all") - F.col("most")) / BUCKET_ROWS).cast("int")
    mixed = mixed.select("key", "cell", "main", by_home.alias("by_home"), n_all.alias("n_all"), n_few.alias("n_few"))
    open_ = rows.join(mixed, ["key", "cell"])
    column = F.pmod(F.xxhash64("rep"), F.col("n_all")).cast("int")
    row = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n_few")).cast("int")
    as_any = F.transform(F.sequence(F.lit(0), F.col("n_few") - 1), lambda i: i * F.col("n_all") + column)
    as_few = F.transform(F.sequence(F.lit(0), F.col("n_all") - 1), lambda j: row * F.col("n_all") + j)
    few = F.when(F.col("by_home"), F.col("home")).otherwise(F.col("component") != F.col("main"))
    to = F.when(few, F.array_distinct(F.concat(as_any, as_few))).otherwise(as_any)
    spread = open_.select("key", "cell", "rep", "n", "component", F.explode(to).alias("at"))
    chunk = F.shiftleft(F.col("cell") + 1, 40) + F.col("at")
    return spread.select("key", chunk.alias("chunk"), "rep", "n", "component")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sets have the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            linked = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(check, "a long, b long, linked boolean").where("linked").select("a", "b")


def join(docs: DataFrame, threshold: int = THRESHOLD, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    return _joined(docs, threshold, size).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD, size: int = SIZE) -> DataFrame:
    """``docs`` with one row of each component, one of its smallest doc_id; rows in no component all stay."""
    found = _joined(docs, threshold, size)
    first = found.where("root is not null and doc_id = component_id").groupBy("root").agg(F.min("row").alias("row")).select("row")
    stays = found.where("root is null").select("row").union(first).withColumn("stays", F.lit(1))
    marked = found.select("row", "doc_id", "tie").join(stays, "row", "left")
    # by doc_id and text, which tell rows apart but for those alike in both: of these as many stay as are marked
    kinds = marked.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n"), F.count("stays").alias("k")).where("k < n")
    kinds = keep(kinds.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("k").alias("_k")), "near-copies")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_tie"))
    alike = docs.join(kinds.where("_k > 0"), on, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(kinds, on, "left_anti").unionByName(alike)


def _joined(docs: DataFrame, threshold: int, size: int) -> DataFrame:
    """row, doc_id, tie, n, root (names the component; null for rows that link with nothing), component_id."""
    prepare(docs.sparkSession)
    rows = signed(docs, size, threshold)
    filled = rows.where("n > 0 and doc_id is not null")
    # a class is represented by one of its rows of the smallest doc_id
    classes = filled.groupBy("set_hi", "set_lo").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    classes = keep(classes.select("set_hi", "set_lo", F.col("least.doc_id").alias("first"), F.col("least.row").alias("rep")), "classes")
    reps = filled.join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    index = reps.select(F.posexplode("keys").alias("place", "key"), F.col("row").alias("rep"), "n", "singles")
    shared = F.when(F.col("place") < F.col("singles"), F.col("n")).otherwise(F.col("n") - F.col("singles"))
    index = index.select("key", "rep", "n", shared.alias("shared"))
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    sizes = keep(sizes.where("lo < hi"), "bucket-sizes")
    known = filled.select(F.col("row").alias("rep"), "n", "sketch")
    wide = filled.select(F.col("row").alias("rep"), "n", "wide")

    # Keys of two documents are most of all: they are pairs as they stand.
    twos = sizes.where("size = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct()
    buckets = keep(index.join(sizes.where("size > 2").select("key", "size", "lo"), "key"), "buckets")

    # First pass: a chunk of a large bucket also gets the bucket's first member, so chunks hang together.
    chunks = F.ceil(F.col("size") / BUCKET_ROWS).cast("int")
    home = F.array(F.pmod(F.xxhash64("rep"), chunks).cast("int"))
    at = F.when((F.col("rep") == F.col("lo")) & (chunks > 1), F.sequence(F.lit(0), chunks - 1)).otherwise(home)
    placed = buckets.select("key", "rep", F.explode(at).alias("chunk")).join(known, "rep").select("key", "chunk", "rep", "n", "sketch")
    found = keep(_pairs(placed, False, threshold).union(twos).distinct(), "pairs")
    pairs = keep(_possible(found, wide, threshold), "pairs")
    named = classes.select("rep", F.col("first").alias("doc_id"), "set_hi", "set_lo")
    sets = _sets(docs, named.join(_nodes(pairs), "rep", "left_semi"), size)
    first = keep(_verified(pairs, sets, threshold), "links")
    merged = keep(components(first), "components")

    # Second pass: buckets that hold several components.
    labelled = buckets.join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "rep"))
    spread = _dealt(labelled, threshold).join(known.select("rep", "sketch"), "rep")
    spread = spread.select("key", "chunk", "rep", "n", "sketch", "component")
    pairs = keep(_possible(_pairs(spread, True, threshold).join(found, ["a", "b"], "left_anti"), wide, threshold), "pairs")
    more = keep(_nodes(pairs).join(sets.select("rep"), "rep", "left_anti"), "members")
    if not more.isEmpty():
        sets = sets.union(_sets(docs, named.join(more, "rep", "left_semi"), size))
    second = keep(_verified(pairs, sets, threshold), "links")
    if not second.isEmpty():
        merged = keep(components(first.union(second)), "components")

    rooted = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    rooted = rooted.select("set_hi", "set_lo", "root").join(least, "root")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = rows.select("row", "doc_id", "tie", "n", "set_hi", "set_lo").join(rooted, ["set_hi", "set_lo"], "left")
    return out.select("row", "doc_id", "tie", "n", F.when(own, F.col("root")).alias("root"), F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """rep, hashes (packed) of members (rep, doc_id, set_hi, set_lo); kept."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, size) for t in batch.column(3).to_pylist()]
            # of rows with one doc_id those of another set go
            same = [_set_hash(h) == [hi, lo] for h, hi, lo in zip(sets, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            packed = pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["rep", "hashes"]).filter(pa.array(same, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id").select("rep", "set_hi", "set_lo", "text")
    return keep(texts.mapInArrow(pack, "rep long, hashes binary"), "sets")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def _possible(pairs: DataFrame, known: DataFrame, threshold: int) -> DataFrame:
    """The pairs that their sizes and wide sketches don't rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                cells = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, cells), axis=0) for v in (x, y))
                differ = max(int(np.bitwise_count(x ^ y).sum(dtype=np.int64)), abs(n - m))
                fits.append(differ * (100 + threshold) <= (n + m) * (100 - threshold))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    one = known.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("wide").alias("x"))
    two = known.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("wide").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(check, "a long, b long")
