"""The pipeline's stages, each on what the one before kept, against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, SF, brute_lines, shingle_set
from tideframe.llm import mixing
from tideframe.llm.tokens import tokenizer_path


def near_groups(texts):
    """The smallest id of each document's group of near copies, by all pairs."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in sets}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    times = Counter(seen)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).collect()
        assert list(out[0].asDict()) == columns
        kept, times = {r["doc_id"]: r["text"] for r in out}, Counter(r["doc_id"] for r in out)
        if name == "language ID":
            assert kept == seen
        elif name == "line dedup":
            order = sorted(seen.items())
            want = {i: t for (i, old), t in zip(order, brute_lines(order), strict=True) if t == old or t.strip()}
            assert kept == want
        elif name.startswith("n-gram"):
            groups = near_groups(seen)
            assert kept == {i: t for i, t in seen.items() if groups[i] == i} and max(times.values()) == 1
            assert len(kept) < len(seen)
        else:  # the mix: words of each source near its target, no document above three times
            assert set(kept.items()) <= set(seen.items()) and max(times.values()) <= 3
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            source = {r["doc_id"]: r["source"] for r in docs.collect()}
            words, taken = Counter(), Counter()
            for i, t in seen.items():
                words[source[i]] += size(t)
                taken[source[i]] += times[i] * size(t)
            for s, goal in mixing.targets(list(words.items())).items():
                assert abs(taken[s] - goal) <= max(2, 0.005 * goal)
        docs, seen = spark.createDataFrame(out, docs.schema), kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tok, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for i, t in seen.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), 4096):
            want[i, a, zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)] += times[i]
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in pieces) == want


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "die und der das ist nicht"), (4, "die und der das ist nicht"), (None, "the and of to in is")]
    docs = spark.createDataFrame([(i, t, "de" if t and "die" in t else "en", None, 0, 1, 2, 3) for i, t in rows], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


def test_repeated_rows(spark):
    """Rows of one doc_id: each text counts by itself, and of equal rows one is left."""
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(30))
    rows = [(7, text), (7, text), (7, other), (8, text + " end"), (None, text), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(7, text), (7, other), (None, text), (9, None), (9, None)])
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    sizes = sum(r["times"] * r["size"] for r in mixing.mix(docs).collect())
    assert sum(len(r["text"].split()) for r in mixed.collect()) == sizes == 40 * 4 + 1 + 30
