"""Phrases whose words keep together, counted by direct-address tiles.

Words are ranked by frequency and numbered by rank; a pair of neighbouring words is a cell of a table
that is cut into tiles of ``SIDE`` by ``SIDE`` numbers. A task counts a tile that it meets often enough
in a dense array (numpy's bincount on the cell's address) and all other pairs as sorted coordinates; only
its counts are shuffled, never occurrences. Frequent pairs are ranked and numbered anew, and pairs of
overlapping pairs are counted in the same way: these are the triples; pairs of triples are the phrases
of four words. A phrase can only be frequent if both of its parts are, so others are never counted.

What a worker knows of a level is bounded whatever the size of the corpus: the numbers of at most
``HEAD`` frequent phrases, and a bitmap of ``FILTER_BITS`` bits. A frequent phrase beyond those has no
rank; its number is a hash of 62 bits, and the bitmap says which hashes may belong to a frequent phrase
(where it errs, more is counted, and the exact counts decide). Strings are joined to counts at the end,
for frequent phrases only.

Scores, for each cut of a phrase into two parts, are floor(scale * a / (l + r)) in decimal arithmetic.
A phrase that some longer frequent phrase contains ``covered`` times out of a hundred, or more, goes;
it is enough to look at phrases one word longer, as what a still longer one contains often, they do too.

Cases: null and empty texts have no words; null languages count as ``und``; repeated rows count each
time; words are of any length (long ones are never ranked); ties are ordered by the phrase's bytes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import keep, prepare
from tideframe.llm.shingles import mix

LEAST, TOP, MOST_WORDS, COVERED, SCALE = 30, 2000, 4, 80, 2_000_000
#: Phrases of a level that are ranked; each is 16 bytes on a worker.
HEAD = 1 << 16
FILTER_BITS = 25
SIDE_BITS = 10
#: A tile is dense if a buffer holds a pair for each so many of its cells.
DENSE = 8
#: Pairs that a task gathers before it counts them, dense tiles it holds, and words it remembers.
BUFFER, MOST_TILES, MEMORY_WORDS = 1 << 21, 24, 1 << 19
_TAIL = 1 << 62
_BREAK = b"\xff"  # no byte of UTF-8
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TRANSLATED = bytes.maketrans(_ENDS + bytes(range(65, 91)), _BREAK * len(_ENDS) + bytes(range(97, 123)))
#: Salts of the first of two rounds that find the best phrases of a language.
_SALTS = 256


def words_of(texts: list[bytes]) -> list[bytes]:
    """The words of texts, with a break wherever a piece or a text ends."""
    return _BREAK.join(texts).translate(_TRANSLATED).replace(_BREAK, b" " + _BREAK + b" ").split()


def _by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    texts = defaultdict(list)
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            texts[lang].append(text)
    return texts


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: how often each word occurs, and in the row without a word how many there are in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in totals.items():
                counts.pop(_BREAK, None)
                n = np.fromiter(counts.values(), np.int64, len(counts))
                words = pc.cast(pa.array([*counts, None], pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(np.append(n, n.sum()))], names=["lang", "word", "n"])
            totals.clear()

        held = 0
        for batch in batches:
            for lang, texts in _by_language(batch).items():
                before = len(totals[lang])
                totals[lang].update(words_of(texts))
                held += (len(totals[lang]) - before) * 64 + sum(len(t) for t in texts) // 8
            if held > 64 * MEMORY_WORDS:
                yield from flush()
                held = 0
        yield from flush()

    return _rows(docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of symbols."""
    return mix(mix(a.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64))


class Level:
    """Numbers of the frequent phrases of one length: by rank for the most frequent, by hash for the others."""

    def __init__(self, ranked: np.ndarray, bitmap: np.ndarray):
        """``ranked``: hashes by rank; ``bitmap``: bytes, a bit for each hash modulo their number of bits."""
        self.order = np.argsort(ranked)
        self.hashes, self.bitmap = ranked[self.order], bitmap

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each phrase given by its hash, -1 if it can't be frequent."""
        bit = hashes & np.uint64(len(self.bitmap) * 8 - 1)
        maybe = self.bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
        found = np.where(maybe > 0, (hashes >> np.uint64(2)).astype(np.int64) | _TAIL, -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == hashes, self.order[at], found)
        return found

    def pairs(self, symbols: np.ndarray) -> np.ndarray:
        """Numbers of the phrases made by each symbol and the next; -1 if either is."""
        found = np.full(max(0, len(symbols) - 1), -1, np.int64)
        both = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        found[both] = self.symbols(pair_hashes(symbols[both], symbols[both + 1]))
        return found


class _Words(dict):
    """Symbols of a language's words, looked up once for each word that is not very long."""

    def __init__(self, lang: str, level: Level):
        self.lang, self.level = lang, level
        self[_BREAK] = -1

    def __missing__(self, word: bytes) -> int:
        found = int(self.level.symbols(np.array([word_hash(self.lang, word)], np.uint64))[0])
        if len(word) <= 256:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words).difference(self) if len(w) <= 256]
        if len(self) + len(new) > MEMORY_WORDS:
            self.clear()
            self[_BREAK] = -1
            new = [w for w in set(words).difference(self) if len(w) <= 256]
        if new:
            hashes = np.array([word_hash(self.lang, w) for w in new], np.uint64)
            self.update(zip(new, self.level.symbols(hashes).tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Tiles:
    """Counts pairs of symbols: dense tiles for the whole task, sorted coordinates for each buffer of pairs."""

    def __init__(self, head: int = HEAD, side_bits: int = SIDE_BITS, buffer: int = BUFFER, dense: int = DENSE):
        """``head``: symbols below it are ranks, a whole number of tiles across."""
        self.head, self.bits, self.buffer, self.least = head, side_bits, buffer, (1 << 2 * side_bits) // dense
        self.across = -(-head >> side_bits)
        self.tiles: dict[int, np.ndarray] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.parts.append((a, b))
        self.held += len(a)
        if self.held >= self.buffer:
            yield from self._count()

    def _count(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        side = (1 << self.bits) - 1
        head = self.head
        inside = (a < head) & (b < head)
        tile = np.where(inside, (a >> self.bits) * self.across + (b >> self.bits), self.across**2)
        many = np.bincount(tile, minlength=self.across**2 + 1)[:-1]
        rest = np.ones(len(a), bool)
        for t in np.flatnonzero((many >= self.least) | np.isin(np.arange(len(many)), list(self.tiles)) & (many > 0)).tolist():
            if t not in self.tiles and len(self.tiles) >= MOST_TILES:
                continue
            at = tile == t
            counts = np.bincount((a[at] & side) << self.bits | b[at] & side, minlength=1 << 2 * self.bits)
            self.tiles[t] = self.tiles[t] + counts if t in self.tiles else counts
            rest &= ~at
        a, b = a[rest], b[rest]
        # Sparse: two numbers of 32 bits make a key; hashes are numbered for this buffer behind the ranks.
        tails = np.unique(np.concatenate([a[a >= head], b[b >= head]]))
        number = lambda x: np.where(x < head, x, head + np.searchsorted(tails, x))
        keys, n = np.unique(number(a) << 32 | number(b), return_counts=True)
        symbol = lambda x: np.where(x < head, x, tails[np.maximum(x - head, 0)] if len(tails) else x)
        yield symbol(keys >> 32), symbol(keys & 0xFFFFFFFF), n

    def finish(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.parts:
            yield from self._count()
        for t, counts in self.tiles.items():
            cell = np.flatnonzero(counts)
            first, second = divmod(t, self.across)
            yield (first << self.bits) + (cell >> self.bits), (second << self.bits) + (cell & ((1 << self.bits) - 1)), counts[cell]
        self.tiles = {}


def pair_counts(docs: DataFrame, levels: list[Level], head: int = HEAD, side_bits: int = SIDE_BITS, buffer: int = BUFFER, dense: int = DENSE) -> DataFrame:
    """a, b, n: how often phrases of ``len(levels)`` words overlap their next by all words but one."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # bounded by HEAD and FILTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, *more = shared.value
        words: dict[str, _Words] = {}
        tiles = Tiles(head, side_bits, buffer, dense)

        def sent(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for columns in found:
                for lo in range(0, len(columns[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 18)].astype(np.int64)) for c in columns], names=["a", "b", "n"])

        for batch in batches:
            for lang, texts in _by_language(batch).items():
                if lang not in words:
                    if len(words) >= 16:
                        words.clear()
                    words[lang] = _Words(lang, first)
                symbols = words[lang].of(words_of(texts))
                for level in more:
                    symbols = level.pairs(symbols)
                both = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
                yield from sent(tiles.add(symbols[both], symbols[both + 1]))
        yield from sent(tiles.finish())

    return _rows(docs).mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _hashed_words(frequent: DataFrame) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [word_hash(lang, word) for lang, word in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.array(keys, np.uint64).view(np.int64))], names=["lang", "word", "n", "h"])

    return frequent.select("lang", "word", "n", F.col("word").cast("binary").alias("raw")).mapInArrow(add, "lang string, word string, n long, h long")


def _hashed_pairs(frequent: DataFrame) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair_hashes(a, b).view(np.int64))], names=["a", "b", "n", "h"])

    return frequent.select("a", "b", "n").mapInArrow(add, "a long, b long, n long, h long")


def ranked(frequent: DataFrame, head: int = HEAD, filter_bits: int = FILTER_BITS, rankable: Column | None = None) -> tuple[DataFrame, Level]:
    """``frequent`` with ``sym``, the number of each row by its hash ``h``, and the level that workers know.

    The most frequent rows are ranked, by count and hash: all those above a count that leaves at most ``head``.
    """
    eligible = frequent if rankable is None else frequent.where(rankable)
    step = F.floor(16 * F.log2(F.col("n"))).cast("int")
    sizes = sorted(eligible.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)  # at most 16 * 64
    total, cut = 0, None
    for row in sizes:
        total += row["rows"]
        if total > head:
            break
        cut = row["step"]
    rows = [] if cut is None else eligible.where(step >= cut).select("n", "h").collect()
    hashes = [r["h"] for r in sorted(rows, key=lambda r: (-r["n"], r["h"]))]
    # The bitmap, 64 bits a row: at most 2 ** (filter_bits - 6) rows.
    bit = f"(h & {(1 << filter_bits) - 1})"
    at = F.expr(f"cast({bit} div 64 as int)")
    found = frequent.groupBy(at.alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 as int)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << filter_bits - 6, "<i8")
    bitmap[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    level = Level(np.array(hashes, np.int64).view(np.uint64), bitmap.view(np.uint8))
    ranks = frequent.sparkSession.createDataFrame([(h, i) for i, h in enumerate(hashes)], "h long, rank long")
    tail = F.shiftrightunsigned("h", 2).bitwiseOR(F.lit(_TAIL))
    return frequent.join(F.broadcast(ranks), "h", "left").withColumn("sym", F.coalesce("rank", tail)).drop("rank", "h"), level  # at most ``head`` rows


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, most_words: int = MOST_WORDS, covered: int = COVERED, scale: int = SCALE, head: int = HEAD, filter_bits: int = FILTER_BITS, **tiles: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    ``head``, ``filter_bits`` (6 at least) and ``tiles`` (``side_bits``, ``buffer``, ``dense``) bound what a
    worker holds; results don't depend on them.
    """
    prepare(docs.sparkSession)
    docs = docs.select("lang", "text")
    counted = keep(word_counts(docs).where((F.col("n") >= least) | F.col("word").isNull()), "words")
    totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
    frequent = keep(_hashed_words(counted.where("word IS NOT NULL AND n >= " + str(least))), "frequent-words")
    table, level = ranked(frequent, head, filter_bits, F.octet_length("word") <= 64)
    parts = table.select("sym", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", *[F.col("n").alias(c) for c in ("first_n", "last_n", "pre2_n", "suf2_n")])
    parts, levels, found = keep(parts, "phrases"), [level], []
    for words in range(2, most_words + 1):
        frequent = keep(_hashed_pairs(pair_counts(docs, levels, head, **tiles).where(F.col("n") >= least)), "frequent-pairs")
        table, level = ranked(frequent, head, filter_bits)
        levels.append(level)
        left = parts.select(F.col("sym").alias("a"), "lang", "phrase", "first_n", F.col("n").alias("pre_n"), F.col("pre2_n").alias("_pre2"))
        right = parts.select(F.col("sym").alias("b"), "last", "last_n", F.col("n").alias("suf_n"), F.col("suf2_n").alias("_suf2"))
        grown = table.join(left, "a").join(right, "b")
        own = words == 2
        grown = grown.select(
            "a", "b", "sym", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "n", "first_n", "last_n", "pre_n", "suf_n",
            F.col("n" if own else "_pre2").alias("pre2_n"), F.col("n" if own else "_suf2").alias("suf2_n"),
        )
        grown = keep(grown, "phrases")
        if found:
            longer = grown.select(F.explode(F.array("a", "b")).alias("sym"), "n").groupBy("sym").agg(F.max("n").alias("longer"))
            found[-1] = found[-1].join(longer, "sym", "left")
        found.append(grown)
        parts = grown
    found[-1:] = [f.withColumn("longer", F.lit(None).cast("long")) for f in found[-1:]]
    return _best([_scored(f, words, covered, scale) for words, f in enumerate(found, 2)], totals, top)


def _scored(table: DataFrame, words: int, covered: int, scale: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of so many words that no longer one covers."""
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    table = table.where(F.col("longer").isNull() | (100 * whole("longer") < covered * whole("n")))
    cuts = {1: ("first_n", "suf_n"), words - 1: ("pre_n", "last_n")}
    if words == 4:
        cuts[2] = ("pre2_n", "suf2_n")
    elif words == 2:
        cuts = {1: ("pre_n", "suf_n")}
    options = []
    for k, (left, right) in sorted(cuts.items()):
        score = F.expr(f"(cast(n as decimal(20,0)) * {scale}) div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0)))")
        options.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")))
    cut = F.array_min(F.array(*options))
    return table.select("lang", "phrase", F.col("n").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _best(tables: list[DataFrame], totals: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language: of each salt first, so that a language is many tasks."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE = """
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM p),
    g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    f AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS ws, count(*) AS a FROM g, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
    q AS (SELECT * FROM f WHERE a >= 30),
    t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT *, unnest(range(1, k)) AS cut FROM q WHERE k > 1),
    s AS (SELECT c.*, x.a AS l, y.a AS r, (2000000 * c.a::HUGEINT // (x.a + y.a))::BIGINT AS score
          FROM c JOIN q x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, cut) JOIN q y ON y.lang = c.lang AND y.ws = list_slice(c.ws, cut + 1, c.k)),
    m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, cut) = 1),
    u AS (SELECT lang, list_slice(ws, i, j) AS ws, max(a) AS longer
          FROM (SELECT lang, ws, k, a, unnest(range(1, k)) AS i FROM q WHERE k > 2), (SELECT unnest([2, 3, 4]) AS j) WHERE j > i AND j <= k AND j - i + 1 < k GROUP BY ALL),
    o AS (SELECT m.lang, array_to_string(m.ws, ' ') AS phrase, a, l, r, score FROM m LEFT JOIN u ON u.lang = m.lang AND u.ws = m.ws
          WHERE longer IS NULL OR 100 * longer < 80 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
    FROM o JOIN t USING (lang) QUALIFY rank <= 2000"""
