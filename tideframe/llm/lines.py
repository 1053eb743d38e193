"""Line dedup by overlapping three-line windows.

Each window of three consecutive lines is hashed (128 bits); of a window found more than once, in the
same or another document, the first occurrence by (doc_id, line number) stays and the lines of all
later ones go. Windows overlap, so what goes is the union of the covered lines.

A hot window is counted with map-side combine, and later occurrences meet the first one, stored by
itself, in an equi-join that AQE can split.

Cases: documents of fewer than three lines have no window and stay as they are; null and empty texts
too; a document whose lines all go gets an empty text; of rows with one doc_id the order is that of a
hash of their texts; of rows equal in doc_id and text all but one are later copies and lose all lines
(if they have three); null doc_ids come first; an empty table gives an empty table; other columns are
kept.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import keep, prepare

LINES = 3


def windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """hi, lo (the window's hash), doc_id, tie (tells rows of one doc_id apart), line (its first line)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids, ties, at = [], [], [], []
            for doc, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                lines = text.split("\n") if text else []
                n = len(lines) - size + 1
                if n <= 0:
                    continue
                each = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines]
                words += [hashlib.blake2b(b"".join(each[i : i + size]), digest_size=16).digest() for i in range(n)]
                ids += [doc] * n
                ties += [tie] * n
                at.append(np.arange(n, dtype=np.int32))
            pair = np.frombuffer(b"".join(words), "<i8").reshape(-1, 2)
            line = np.concatenate(at) if at else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(line)],
                names=["hi", "lo", "doc_id", "tie", "line"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").where(F.col("text").contains("\n"))
    return rows.mapInArrow(hashes, "hi long, lo long, doc_id long, tie long, line int")


def repeated_windows(docs: DataFrame, size: int = LINES) -> DataFrame:
    """doc_id, tie, starts: the first lines of the windows that have an earlier occurrence; rows are distinct."""
    found = keep(windows(docs, size), "line-windows")
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "tie", "line")
    firsts = found.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = keep(firsts.select("hi", "lo", "first"), "first-windows")  # so that the join reads plain rows on both sides
    later = found.join(firsts, ["hi", "lo"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie")) & (F.col("line") == F.col("first.line"))
    return later.where(~same).groupBy("doc_id", "tie").agg(F.collect_set("line").alias("starts"))


def _line_count() -> Column:
    return F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("int")


def dedup_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """``docs`` with the repeated lines gone, and n_lines, n_removed (names of ``docs`` win no clash)."""
    prepare(docs.sparkSession)
    clean = docs.drop("n_lines", "n_removed", "_starts", "_tie", "_row")
    tied = clean.withColumn("_tie", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t"))

    # Rows equal in doc_id and text: numbered once and for all, so that one of them is the first.
    alike = tied.groupBy(F.col("doc_id").alias("_id"), F.col("_tie").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    alike = keep(alike, "rows-alike")
    later = None
    if not alike.isEmpty():
        rows = keep(tied.join(alike, on, "left_semi").withColumn("_row", F.monotonically_increasing_id()), "copies")
        first = rows.groupBy(F.col("doc_id").alias("_id"), F.col("_tie").alias("_t")).agg(F.min("_row").alias("_first"))
        rows = rows.join(first, on)
        later = rows.where("_row > _first").select(*tied.columns)
        tied = tied.join(alike, on, "left_anti").unionByName(rows.where("_row = _first").select(*tied.columns))

    starts = repeated_windows(tied.select(*clean.columns), size).withColumnRenamed("doc_id", "_id").withColumnRenamed("tie", "_t")
    joined = tied.join(starts, on, "left").withColumn("n_lines", _line_count())

    def without(texts: pd.Series, starts: pd.Series) -> pd.Series:
        kept = []
        for text, begin in zip(texts, starts, strict=True):
            if text is None or begin is None:
                kept.append(text)
                continue
            lines = text.split("\n")
            gone = np.zeros(len(lines), bool)
            for k in range(size):
                gone[np.asarray(begin) + k] = True
            kept.append("\n".join(itertools.compress(lines, ~gone)))
        return pd.Series(kept, dtype=object)

    # not to be planned twice where later steps look at the text; untouched texts don't travel
    kept = F.pandas_udf(without, "string").asNondeterministic()
    new = kept(F.when(F.col("starts").isNotNull(), F.col("text")), "starts")
    out = joined.withColumn("_new", new).withColumn("text", F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.col("_new")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + size - 1)))))
    out = out.withColumn("n_removed", F.when(F.col("starts").isNull(), 0).otherwise(covered))
    out = out.select(*clean.columns, "n_lines", "n_removed")
    if later is None:
        return out
    later = later.withColumn("n_lines", _line_count())
    whole = F.col("n_lines") >= size
    later = later.withColumn("n_removed", F.when(whole, F.col("n_lines")).otherwise(0)).withColumn("text", F.when(whole, "").otherwise(F.col("text")))
    return out.unionByName(later.select(*out.columns))


ORACLE = """
    WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    w AS (SELECT doc_id, i - 1 AS line, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS win
          FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)),
    r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY win ORDER BY doc_id, line) AS k FROM w),
    c AS (SELECT doc_id, list_distinct(flatten(list([line, line + 1, line + 2]))) AS gone FROM r WHERE k > 1 GROUP BY doc_id)
    SELECT l.doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE len(lines) END::INTEGER AS n_lines,
           coalesce(len(gone), 0)::INTEGER AS n_removed,
           CASE WHEN text IS NULL THEN NULL WHEN gone IS NULL THEN sha256(text) ELSE
             sha256(array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: lines[i]), chr(10)))
           END AS kept_sha256
    FROM l LEFT JOIN c USING (doc_id)"""
