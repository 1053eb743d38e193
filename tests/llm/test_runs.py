"""Periodic runs against brute force: all short texts over small alphabets, planted periods, odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from tideframe.llm import queries, runs


def brute(words, least=12):
    """Every run by its definition."""
    n, found = len(words), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.add((i, j + q - i, q))
            i = max(j, i) + 1
    best = {}
    for s, m, q in found:
        best[s, m] = min(q, best.get((s, m), q))
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def of_words(texts, least=12):
    sizes = np.array([len(t) for t in texts])
    return runs.find(np.array([w for t in texts for w in t], np.int64) + 1, sizes, least)


@pytest.mark.parametrize("least", [2, 4, 7])
def test_all_short_texts(least):
    texts = [t for n in range(1, 11) for t in itertools.product(range(2), repeat=n)] + list(itertools.product(range(3), repeat=6))
    for text, got in zip(texts, of_words(texts, least), strict=True):
        assert got == brute(text, least), text


def test_random_and_periodic_texts():
    rng, texts = np.random.default_rng(3), []
    for _ in range(400):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            unit = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 30)))
            parts.append(np.tile(unit, int(rng.integers(1, 8)))[: int(rng.integers(1, 150))])
        texts.append(np.concatenate(parts).tolist())
    fibonacci, last = [0, 1], [0]
    while len(fibonacci) < 600:
        fibonacci, last = fibonacci + last, fibonacci
    texts += [fibonacci, [0] * 700, [0, 1] * 300, [bin(i).count("1") % 2 for i in range(600)], texts[0], texts[0]]
    for text, got in zip(texts, of_words(texts), strict=True):
        assert got == brute(text), text


def test_query_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op13_runs(spark, sf).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    assert got == sorted(expected(d, t) for d, t in docs)
    assert any(r[1] for r in got)


def test_odd_rows_and_batches(spark, monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    monkeypatch.setattr(runs, "MEMORY_WORDS", 10)
    line = "the same line of seven words again"
    texts = [None, "", "  \n\t ", "one", "a " * 5000, (line + "\n") * 9, "a\x0bb\x0cc\x1cd " * 40, "É é " * 20, f"x {line} y {line} z", "ab " * 11, "ab " * 12]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z z " * 30), (5, texts[5]), (5, texts[5])]
    table = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, runs int, collapsed string").repartition(2)
    got = runs.report(runs.collapse(table)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t, plant=False) for i, t in rows), key=repr)
    assert runs.collapse(table.where("doc_id < 0")).count() == 0
    collapsed = {r["doc_id"]: r["collapsed"] for r in runs.collapse(table).collect()}
    assert collapsed[5] == line and collapsed[4] == "a"
