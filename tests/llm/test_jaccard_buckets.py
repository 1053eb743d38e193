"""Large buckets of the n-gram Jaccard join: split by length, whole in their links, few in candidate rows."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import shingle_set, table
from tideframe.llm import jaccard


def bucket(spark, rows):
    """One bucket of rows (rep, n, shared, component)."""
    made = spark.createDataFrame(rows, "rep long, n long, shared long, component long")
    return made.withColumn("key", F.lit(1).cast("long")).withColumn("size", F.lit(len(rows)).cast("long"))


def may_link(a, b, threshold):
    (_, n, s, _), (_, m, t, _) = a, b
    return min(s, t, n, m) * (100 + threshold) >= threshold * (n + m)


@pytest.mark.parametrize(("threshold", "labels"), [(80, 400), (80, 6), (50, 400)])
def test_pairs_that_may_link_meet(spark, monkeypatch, threshold, labels):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(threshold + labels)
    n = rng.integers(1, 300, 400)
    shared = np.maximum(1, n - (n * rng.choice([0, 0.05, 0.1, 0.12, 0.15, 0.2], 400)).astype(int))
    rows = [(i, int(n[i]), int(shared[i]), int(rng.integers(0, labels))) for i in range(400)]
    chunks = defaultdict(set)
    for r in jaccard._dealt(bucket(spark, rows), threshold).collect():
        assert (r["n"], r["component"]) == (rows[r["rep"]][1], rows[r["rep"]][3])
        assert r["rep"] not in chunks[r["chunk"]]
        chunks[r["chunk"]].add(r["rep"])
    met = {pair for members in chunks.values() for pair in itertools.combinations(sorted(members), 2)}
    wanted = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[3] != b[3] and may_link(a, b, threshold)}
    assert wanted and wanted <= met


def test_template_documents_below_the_threshold_meet_nowhere(spark):
    """100,000 documents of one template, an eighth of each its own: no pair can link, and no row is copied."""
    made = spark.range(100_000).select(
        F.lit(1).cast("long").alias("key"), F.lit(100_000).cast("long").alias("size"), F.col("id").alias("rep"),
        F.lit(200).cast("long").alias("n"), F.lit(175).cast("long").alias("shared"), F.col("id").alias("component"),
    )
    assert jaccard._dealt(made, 80).count() == 0


def test_rows_of_many_lengths_are_copied_little(spark):
    """100,000 rows of 50 to 5,000 shingles: chunks are those of near lengths, not of the bucket (196 copies a row)."""
    made = spark.range(100_000).select(
        F.lit(1).cast("long").alias("key"), F.lit(100_000).cast("long").alias("size"), F.col("id").alias("rep"),
        F.floor(50 * F.exp(F.lit(np.log(100.0)) * F.col("id") / 100_000)).alias("n"), F.col("id").alias("component"),
    ).withColumn("shared", F.col("n"))
    assert jaccard._dealt(made, 80).count() < 40 * 100_000


def test_template_documents_link_as_by_brute_force(spark, monkeypatch):
    """A template with own words in the middle or at the end, so many that neighbours just link or just don't."""
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(5)
    template = [f"t{i}" for i in range(160)]
    rows = []
    for i in range(150):
        own = [f"d{i}x{j}" for j in range(int(rng.choice([2, 8, 14, 20, 26, 34])))]
        at = int(rng.choice([80, 160]))
        cut = int(rng.choice([160, 160, 140, 125]))
        rows.append((i, " ".join([*template[:at], *own, *template[at:cut]]), None, None))
    sets = [shingle_set(t) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(table(spark, rows)).collect()}
    assert got == {i: root(i) for i in range(len(rows))}
    assert 3 < len(set(got.values())) < len(rows)
