"""Language identification by rank-order profiles of n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 letters, words padded by a mark at
both ends), most frequent first. A document's own most frequent n-grams are compared to each profile
by out-of-place distance: how far each n-gram's rank is from its rank in the profile, or the profile's
length where it is missing; the nearest profile names the language.

Training counts n-grams over every labelled training document: tasks count, Spark sums. What reaches
the driver is ``profile`` n-grams for each language, whatever the size of the corpus.

Cases: a text that is null or has no letter gets ``und`` and score 0, and so does every text when
nothing was learned; n-grams of one frequency rank by their code points; of languages at one distance
the first by name wins; words of more than half a million letters are cut there; repeated rows are predicted alike; other columns are kept, a clashing
lang_pred or score is replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import prepare

PROFILE = 300
UNKNOWN = "und"
#: N-grams that a task holds before it passes them on.
HELD_GRAMS = 1 << 20
#: Texts, and characters of texts, that are counted at once.
_CHUNK = 256
_CHARS = 1 << 18
#: Up to so many possible n-grams are counted by place, more by sorting.
_DENSE = 1_000_000
_BITS = np.uint64(21)


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _pieces(points: np.ndarray) -> list[np.ndarray]:
    """A text's code points in pieces of at most ``_CHARS``, cut between words."""
    found = []
    while len(points) > _CHARS:
        gaps = np.flatnonzero(~_letters()[points[:_CHARS]])
        cut = int(gaps[-1]) + 1 if len(gaps) else _CHARS
        found.append(points[:cut])
        points = points[cut:]
    return [*found, points]


def _counted(parts: list[np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, how often) of pieces of texts; ``owner``: the text of each piece; ordered by both.

    An n-gram is its code points, 21 bits each, 1 standing for a word's mark. Letters are numbered among
    the pieces first, so that an n-gram is a small number while it is counted.
    """
    gap = np.zeros(1, np.uint32)
    points = np.concatenate([gap, *(x for part in parts for x in (part, gap))])
    doc = np.append(owner[:1], np.repeat(owner, [len(part) + 1 for part in parts]))
    present = np.flatnonzero(np.bincount(points))
    alphabet = np.append(1, present[_letters()[present]])
    number = np.zeros(int(points.max()) + 1, np.int64)
    number[alphabet[1:]] = np.arange(1, len(alphabet))
    c, size = number[points], len(alphabet)
    one = np.flatnonzero(c)
    pair = c[:-1] * size + c[1:]
    two = np.flatnonzero(pair)
    three = (c[one - 1] * size + c[one]) * size + c[one + 1]
    ids = np.concatenate([c[one], size + pair[two], size + size * size + three])
    # the gap after a text belongs to it, so a pair that begins with a gap is that of the next letter
    where = np.concatenate([doc[one], np.where(c[two] > 0, doc[two], doc[two + 1]), doc[one]])
    total = size + size**2 + size**3
    if total <= _DENSE:
        used = np.flatnonzero(np.bincount(ids, minlength=total))
        slot = np.zeros(total, np.int32)
        slot[used] = np.arange(len(used))
        at = slot[ids]
    else:
        used, at = np.unique(ids, return_inverse=True)
    code = alphabet.astype(np.uint64)
    kind = (used >= size).astype(int) + (used >= size + size * size)
    rest = used - np.array([0, size, size + size * size])[kind]
    last, middle, front = code[rest % size], code[rest // size % size], code[rest // (size * size)]
    gram = np.where(kind == 0, last, np.where(kind == 1, middle << _BITS | last, front << (_BITS + _BITS) | middle << _BITS | last))
    place = np.empty(len(used), np.int64)
    place[np.argsort(gram)] = np.arange(len(used))  # n-grams in the order of their code points
    keys = np.sort(where * len(used) + place[at])
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    keys, n = keys[first], np.diff(np.append(first, len(keys)))
    gram.sort()
    return keys // max(1, len(used)), gram[keys % max(1, len(used))], n


def counts(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches lo..hi of the texts: (lo, hi, text, n-gram, how often), texts numbered from lo."""
    held, owner, chars, lo = [], [], 0, 0
    for k, text in enumerate(texts):
        points = _points(text)
        if held and (k - lo >= _CHUNK or chars + len(points) > _CHARS):
            yield lo, k, *_counted(held, np.array(owner))
            held, owner, chars, lo = [], [], 0, k
        pieces = _pieces(points)
        if len(pieces) > 1:  # a very long text by itself, piece by piece
            parts = [_counted([piece], np.zeros(1, np.int64)) for piece in pieces]
            gram, slot = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            n = np.bincount(slot, np.concatenate([p[2] for p in parts])).astype(np.int64)
            if held:
                yield lo, k, *_counted(held, np.array(owner))
            yield k, k + 1, np.zeros(len(gram), np.int64), gram, n
            held, owner, chars, lo = [], [], 0, k + 1
            continue
        held.append(points)
        owner.append(k - lo)
        chars += len(points)
    if held:
        yield lo, len(texts), *_counted(held, np.array(owner))


def learn(docs: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of ``docs(text, lang)``: language -> its n-grams, most frequent first."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (gram, n) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            langs, code = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for lo, _, text, gram, n in counts(batch.column(0).to_pylist()):
                spoken = code[lo + text]
                for k in np.unique(spoken).tolist():
                    mine, lang = spoken == k, str(langs[k])
                    grams, times = [gram[mine]], [n[mine]]
                    if lang in total:
                        grams.append(total[lang][0])
                        times.append(total[lang][1])
                    found, slot = np.unique(np.concatenate(grams), return_inverse=True)
                    total[lang] = found, np.bincount(slot, np.concatenate(times)).astype(np.int64)
            if sum(len(g) for g, _ in total.values()) > HELD_GRAMS:
                yield from out()
                total = {}
        yield from out()

    parts = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    sums = parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= profile).collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.uint64) for lang, grams in found.items()}


def classify(texts: list[str | None], profiles: dict[str, np.ndarray], profile: int = PROFILE) -> list[tuple[str, float]]:
    """(language, score) of each text; the score is 1 minus the share of the largest distance."""
    langs = sorted(profiles)
    out: list[tuple[str, float]] = []
    for lo, hi, text, gram, n in counts(texts):
        if not len(gram) or not langs:
            out += [(UNKNOWN, 0.0)] * (hi - lo)
            continue
        order = np.lexsort((gram, -n, text))  # of each text the most frequent first, ties by n-gram
        text, gram = text[order], gram[order]
        begin = np.searchsorted(text, np.arange(hi - lo))
        rank = np.arange(len(text)) - begin[text]
        top = rank < profile
        text, gram, rank = text[top], gram[top], rank[top]
        far = np.empty((len(langs), hi - lo))
        for i, lang in enumerate(langs):
            grams = profiles[lang]
            by_code = np.argsort(grams)
            slot = np.minimum(np.searchsorted(grams, gram, sorter=by_code), len(grams) - 1)
            place = by_code[slot]
            off = np.where(grams[place] == gram, np.abs(place - rank), profile)
            far[i] = np.bincount(text, off, hi - lo)
        held = np.bincount(text, minlength=hi - lo)
        best = far.argmin(axis=0)
        near = 1 - far[best, np.arange(hi - lo)] / (profile * np.maximum(held, 1))
        out += [(langs[b], float(s)) if k else (UNKNOWN, 0.0) for b, s, k in zip(best, near, held, strict=True)]
    return out


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score; only the text is looked at."""
    prepare(docs.sparkSession)

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(classify(batch.tolist(), profiles, profile), columns=["lang_pred", "score"])

    labelled = F.pandas_udf(label, "lang_pred string, score double")
    clean = docs.drop("lang_pred", "score", "_label")
    return clean.withColumn("_label", labelled("text")).select(*[F.col(f"`{c}`") for c in clean.columns], "_label.lang_pred", "_label.score")


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning: crc32 of its id, as text, leaves 1 of 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))
