"""The corpus operators against brute force, on small tables with nulls, ties, copies and long texts."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.compare import duck, same
from tideframe.llm import fingerprint, jaccard, langid, lines, mixing, packing, queries, repair, sharding, shingles, substrings, tokens, vectors
from tideframe.llm.common import block_of, components, ranked
from tideframe.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rank int, size int"


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(1)


def table(spark, rows):
    """documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, src, len(t) if t else None, 1, 2, 3) for i, t, lang, src in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus(rng):
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 7)))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    base, passage = prose(120), prose(90)
    rows = [(i, prose(int(rng.integers(5, 200)))) for i in range(20)]
    rows += [(20 + i, base) for i in range(6)]  # exact copies
    for i in range(12):  # near copies
        w = base.split()
        w[int(rng.integers(0, 120))] = f"new{i}"
        rows.append((30 + i, " ".join(w)))
    rows += [(50 + i, f"{prose(30)}\n{passage}\n{prose(30)}") for i in range(6)]
    rows += [(60, None), (61, ""), (62, "  \n "), (63, "one two"), (64, "One TWO"), (65, prose(4000)), (66, "Größe ÉCOLE don't <|endoftext|> it's 3.14 　x\x1cy"), (67, "日本語 テキスト")]
    rows += [(70, rows[0][1]), (70, rows[0][1]), (None, "null id text here now please")]
    sources = itertools.cycle(["s0", "s0", "s1", None, "s2"])
    return [(i, t, "en" if (i or 0) % 4 else None, next(sources)) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return table(spark, corpus).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(0, "x", None, None)]).where("doc_id < 0")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, con, name):
    same(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


def test_empty_tables(spark, empty):
    assert repair.read_documents(repair.write_shards(empty)).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
    assert substrings.dedup(empty).count() == 0
    assert fingerprint.fingerprints(empty).count() == 0
    assert jaccard.join(empty).count() == 0
    assert langid.learn(empty) == {}
    assert langid.predict(empty, {}).count() == 0
    assert vectors.near(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_encoder_is_the_tokenizer(corpus, con):
    texts = [t for _, t, _, _ in corpus] + [t for (t,) in con.execute("SELECT text FROM documents LIMIT 60").fetchall()]
    texts += [f"a{chr(c)}b {chr(c)} X{chr(c)}...!, " for c in range(1, 0x260)]  # each letter that may take the short way, and more
    texts += ["\xa0b\x85c ΣΑΣ İstanbul e\u0301 ABC!? (abc) #x# <|startoftext|>abc.", "x" * 5000 + ".", "ab" * 40]
    tok = Tokenizer.from_file(tokenizer_path())
    for path in (tokenizer_path(), tokenizer_path("byte_bpe_50k.json")):
        enc, tok = Encoder(path), Tokenizer.from_file(path)
        assert enc.by_word == (path == tokenizer_path())
        for lo in (0, 40, 0):  # the second and third time with a memory
            for text, ids in zip(texts[lo:], enc.each(pa.array(texts[lo:]), end=None), strict=True):
                assert ids.tolist() == tok.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_forgets(monkeypatch, corpus):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 50)
    monkeypatch.setattr(tokens, "WORDS_A_STEP", 7)
    texts = pa.array([t for _, t, _, _ in corpus])
    enc, tok = Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for lo in range(0, len(texts), 5):
        part = texts[lo : lo + 5]
        for text, ids in zip(part.to_pylist(), enc.each(part), strict=True):
            assert ids.tolist() == [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert len(enc.words) <= 50 and len(enc.ids) == enc.size.sum()


def test_token_files(docs, corpus):
    tok = Tokenizer.from_file(tokenizer_path())
    got = sorted((tuple(r)[:4] for r in repair.read_documents(repair.write_shards(docs)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _, _, _ in corpus), key=lambda i: (i is not None, i or 0))
    want, start = Counter(), 0
    for doc, text, _, _ in corpus:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    for r in got:
        assert r[1] == start
        start += r[2]


@pytest.mark.parametrize("first", [300, 70_000])
def test_repair_round_trip(rng, first):
    ids = rng.zipf(1.3, 30_000).clip(1, first - 1).astype(np.uint32)
    ids[100:400] = 7  # overlapping pairs
    for k in range(20):  # a long passage many times
        ids[10_000 + 700 * k : 10_300 + 700 * k] = ids[500:800]
    ends = np.sort(rng.choice(29_999, 40, replace=False))
    ends = np.append(ends, 29_999)
    symbols, rules, at = repair.compress(ids, ends, first)
    shard = repair.Shard(repair.pack(symbols, rules, at, first))
    assert len(rules) > 10 and len(symbols) < 0.6 * len(ids) and shard.lengths.max() > 40
    begins = np.append(0, at[:-1] + 1)
    left = Counter(p for a, b in zip(begins, at, strict=True) for p in zip(symbols[a:b].tolist(), symbols[a + 1 : b + 1].tolist(), strict=True) if p not in set(map(tuple, rules.tolist())))
    assert max(left.values()) < repair.LEAST_COUNT  # no frequent pair is left without a rule
    whole = list(shard.documents())
    assert np.array_equal(np.concatenate(whole), ids)
    for d in (0, 3, 40):
        assert np.array_equal(shard.document(d), whole[d])
        n = len(whole[d])
        for a, b in ((0, n), (n // 3, n // 2 + 1), (n - 1, n)):
            assert np.array_equal(shard.token_range(d, a, b), whole[d][a:b])


@pytest.mark.parametrize("most", [4, 256])
def test_packing(docs, corpus, most):
    got = packing.pack_documents(docs, length=64, most=most).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    by, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
        assert all(r["sequence_length"] == (at if at & (at - 1) == 0 else 64) for r in held)
    want, total = defaultdict(Counter), 0
    for doc, text, _, _ in corpus:  # every document's pieces cover its ids once
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        for a in range(0, len(ids), 64):
            want[doc][a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes()), len(ids)] += 1
    assert {d: Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in x) for d, x in pieces.items()} == want
    assert len(by) <= (1.1 if most > 4 else 1.3) * total / 64 + 1


@pytest.mark.parametrize("n", [9, 17, 33])
def test_packing_short_documents(spark, n):
    rows = [(i, " ".join(["the"] * (n - 1)), None, None) for i in range(1000)]
    got = packing.pack_documents(table(spark, rows)).agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert got[0] == 1000 * n and got[0] >= 0.97 * 4096 * (got[1] - 1)


def test_classes_waste_little(rng):
    histogram = dict(Counter((rng.lognormal(5.5, 1.2, 50_000).astype(int) % 4095 + 1).tolist()))
    found = packing.classes(histogram, 200)
    assert len(set(found.values())) <= 200 and all(k <= c and found[c] == c for k, c in found.items())
    tokens_ = sum(k * n for k, n in histogram.items())
    assert sum(found[k] * n for k, n in histogram.items()) < 1.02 * tokens_
    assert packing.classes({}) == {} and packing.classes({5: 3}) == {5: 5}


def test_cutting_stock_is_near_the_bound(rng):
    for _ in range(4):
        sizes = rng.integers(1, 60, 2000)
        demand = dict(Counter(sizes.tolist()))
        plan = packing.cutting_stock(demand, 64)
        made = Counter()
        for pattern, n in plan:
            assert sum(s * k for s, k in pattern.items()) <= 64
            for s, k in pattern.items():
                made[s] += k * n
        assert made == Counter(demand)
        large = int((sizes > 32).sum())
        assert sum(n for _, n in plan) <= 1.02 * max(large, sizes.sum() / 64) + 3
    assert packing.cutting_stock({}, 64) == []


def test_pricing_is_optimal(rng):
    for _ in range(20):
        sizes = sorted(rng.choice(np.arange(1, 9), 5, replace=False).tolist())
        values = rng.random(5)
        sack = packing.Knapsack(sizes, values, 30)
        f = [0.0]
        for c in range(1, 31):
            f.append(max([f[c - 1], *(v + f[c - s] for s, v in zip(sizes, values.tolist(), strict=True) if s <= c)]))
            pattern = sack.pattern(c)
            assert sum(s * k for s, k in pattern.items()) <= c
            worth = sum(values[sizes.index(s)] * k for s, k in pattern.items())
            assert sack.best[c] == pytest.approx(f[c]) == pytest.approx(worth)


def test_mixing(docs, corpus):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, _, _ in corpus)
    by, source = defaultdict(int), {}
    source_of_long = next(s for _, t, _, s in corpus if size(t) == 4000)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
        source[r["source"]] = (r["source_size"], r["target"])
    assert sum(t for _, t in source.values()) == pytest.approx(sum(s for s, _ in source.values()))
    for s, (_, target) in source.items():
        assert abs(by[s] - target) <= (2 if s != source_of_long else 0.05 * target)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)


def test_targets_reshare():
    got = mixing.targets([("a", 10), ("b", 1000), (None, 1000), ("c", 990)])
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(3000)
    assert got["c"] / 3 == pytest.approx(got["b"] / 2) == pytest.approx(got[None] / 1)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_subset_sum(rng):
    for _ in range(30):
        lengths, counts = np.unique(rng.integers(1, 40, 30), return_counts=True)
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        take = mixing.fill(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        reach = {0}
        for n, k in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {a + j * n for a in reach for j in range(k + 1)}
        assert abs((take * lengths).sum() - budget) == min(abs(x - budget) for x in reach)


@pytest.mark.parametrize("n", [1000, 2500, 8000, 20_000])
def test_subset_sum_of_many_lengths(rng, n):
    lengths, counts = np.unique((rng.pareto(1.1, n) * 40 + 1).clip(1, 60_000).astype(int), return_counts=True)
    total = int((lengths * counts).sum())
    for share in (0.1, 0.5, 0.8, 0.95):
        for repeats in (0, 2):
            take = mixing.fill(lengths, counts, round(share * total), repeats)
            assert (take <= counts).all() and (take >= 0).all()
            assert (take * lengths).sum() == round(share * total)


def test_subset_sum_of_long_documents():
    lengths, counts = np.array([3, 2_000_000, 3_000_000]), np.array([1, 1, 1])
    assert mixing.fill(lengths, counts, 2_000_004).tolist() == [1, 1, 0]
    assert mixing.fill(lengths, counts, 2_900_000).tolist() == [0, 0, 1]


def test_sharding_splits_only_what_is_too_large(docs, corpus):
    got = sharding.shard(docs, 1000).collect()
    assert len(got) == len(corpus)
    by = defaultdict(int)
    for r in got:
        by[r["depth"], r["shard"]] += r["n_bytes"]
    for r in got:
        assert r["shard_bytes"] == by[r["depth"], r["shard"]]
        assert r["shard_bytes"] <= 1000 or r["depth"] == 32
    depths = {d for d, _ in by}
    assert len(depths) > 1


@pytest.mark.parametrize("limit", [3_000, 40_000])
def test_sharding_against_sql(spark, con, limit):
    """At limits that split, down to several depths."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard(docs, limit)
    same(got, con, sharding.oracle(limit))
    assert got.select("depth").distinct().count() > 1


def test_written_shards(spark, docs, corpus, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/out", 1000)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((i, t) for i, t, _, _ in corpus)
    place = {(r["doc_id"], r["depth"], r["shard"]) for r in sharding.shard(docs, 1000).collect()}
    assert {(r["doc_id"], r["depth"], r["shard"]) for r in back.collect()} == place


def brute_lines(rows):
    seen, gone = set(), defaultdict(set)
    for k, (_, text) in enumerate(rows):
        parts = text.split("\n") if text else []
        for i in range(len(parts) - 2):
            window = tuple(parts[i : i + 3])
            if window in seen:
                gone[k] |= {i, i + 1, i + 2}
            seen.add(window)
    return [(t if k not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])) for k, (_, t) in enumerate(rows)]


def test_line_dedup(spark, rng):
    rows = [(i, "\n".join(rng.choice(list("abc"), int(rng.integers(0, 12))))) for i in range(40)] + [(40, None), (41, "a\nb"), (42, "")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, [(i, t, None, None) for i, t in rows])).collect()}
    for (i, t), kept in zip(rows, brute_lines(rows), strict=True):
        assert got[i]["text"] == kept
        assert got[i]["rank"] == 2 and got[i]["n_lines"] == (len(t.split("\n")) if t else 0)


def test_line_dedup_of_repeated_rows(spark):
    text = "a\nb\nc\nd"
    rows = [(1, text)] * 3 + [(1, "x\ny\nz"), (None, text), (2, "q\nr"), (2, "q\nr"), (3, None), (3, None)]
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["rank"]) for r in lines.dedup_lines(table(spark, [(i, t, None, None) for i, t in rows])).collect())
    # the null id comes first, so all copies of doc 1 are later ones
    assert got == Counter({(1, "", 4, 4, 2): 3, (1, "x\ny\nz", 3, 0, 2): 1, (None, text, 4, 0, 2): 1, (2, "q\nr", 2, 0, 2): 2, (3, None, 0, 0, 2): 2})
    got = Counter(r["text"] for r in lines.dedup_lines(table(spark, [(1, text, None, None)] * 3)).collect())
    assert got == Counter({text: 1, "": 2})


def brute_spans(texts, length, first_only):
    where = defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for d, raw in enumerate(data):
        for i in range(len(raw) - length + 1):
            where[raw[i : i + length]].append((d, i))
    out = []
    for d, raw in enumerate(data):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            at = where[raw[i : i + length]]
            if len(at) > 1 and not (first_only and at[0] == (d, i)):
                gone[i : i + length] = True
        out.append((raw, gone))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 60, 200])
def test_longest_factors(rng, n):
    """Against all pairs; and where no pair is: suffix order with common prefixes of any length."""
    place, lcp = rng.permutation(n), rng.integers(0, 4, n)
    previous, next_ = substrings.longest_factors(place, lcp)
    for i in range(n):
        most = {True: 0, False: 0}
        for j in range(n):
            if i != j:
                earlier = bool(place[j] < place[i])
                most[earlier] = max(most[earlier], int(lcp[min(i, j) + 1 : max(i, j) + 1].min()))
        assert (previous[i], next_[i]) == (most[True], most[False])


@pytest.mark.parametrize("length", [3, 8, 10, 40])
def test_ranks_are_suffix_order(rng, length):
    text = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(400 - length + 1)
    prefixes = [text[i : i + length].tobytes() for i in starts]
    order = {x: k for k, x in enumerate(sorted(set(prefixes)))}
    assert substrings.ranks(text, starts, length).tolist() == [order[x] for x in prefixes]


@pytest.mark.parametrize(("keep", "block"), [("none", 2 << 20), ("first", 2 << 20), ("none", 300), ("first", 300)])
def test_substrings(spark, rng, monkeypatch, keep, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)  # small: anchors go on to longer grams
    piece = "".join(rng.choice(list("abcdeé"), 150))
    rand = lambda n: "".join(rng.choice(list("abcdeé"), n))
    texts = [rand(80) + piece + rand(50), piece[20:130] + rand(30), rand(200), "x" * 90, None, "", rand(10) + piece[:70] + rand(5) + piece[60:] + piece[40:110], piece, piece + "!", "ab" * 60]
    texts += [rand(40) + piece[30:100] + rand(20) for _ in range(5)]
    df = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in substrings.dedup(df, length=40, gram=12, keep=keep).collect()}
    for i, (raw, gone) in enumerate(brute_spans(texts, 40, keep == "first")):
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(raw), int(gone.sum()), kept), i
        assert got[i]["n_spans"] == int((np.diff(np.append(0, gone.astype(int))) == 1).sum())


def test_substrings_leave_no_files_of_done_steps(spark, corpus):
    """Before the last step runs, the shuffle files of all before it and the tables that nothing reads any more are gone."""
    local, shared = spark.conf.get("spark.local.dir"), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    shuffles = lambda: {f for _, _, files in os.walk(local) for f in files if f.startswith("shuffle_")}
    tables = lambda: set(os.listdir(shared)) if os.path.isdir(shared) else set()
    texts = spark.createDataFrame([(i, t) for i, t, *_ in corpus], "doc_id long, text string")
    old, had = shuffles(), tables()
    spans = substrings.repeats(texts, length=40, gram=12)
    assert not shuffles() - old
    assert not [t for t in tables() - had if t.startswith(("runs-", "contents-"))]
    assert spans.count() > 0 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_runs_cut_long_texts_alike(monkeypatch, rng):
    raw = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = substrings.runs(raw, 60, 20)
    assert whole[1].sum() == 5000 - 59
    part = substrings.runs(raw[1000:2059], 60, 20)
    anchors = {int(a): int(h) for a, n, h in zip(*whole, strict=True) for a in range(a, a + n)}
    assert all(anchors[1000 + int(a)] == int(h) for a, n, h in zip(*part, strict=True) for a in range(a, a + n))


def shingle_set(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingles(corpus):
    for _, text, _, _ in corpus:
        assert len(shingles.shingle_hashes(text)) == len(shingle_set(text))
    assert len(shingles.word_hashes(b"  ab AB Ab  ")) == 3 and len(set(shingles.word_hashes(b"ab AB Ab").tolist())) == 1
    long = "a" * 9000
    assert len({int(shingles.word_hashes(x.encode())[0]) for x in (long, long + "a", "b" + long[1:], long[:5000] + "b" + long[5001:])}) == 4


@pytest.mark.parametrize("stretch", ["x" * 5000, " " * 5000, "日" * 3000])
def test_long_stretches_leave_other_words_alone(spark, stretch):
    words = [f"w{i}" for i in range(300)]
    plain = " ".join(words)
    for text in (f"{stretch} {plain}", f"{plain} {stretch}", " ".join([*words[:100], stretch, *words[100:]])):
        shared = set(shingles.word_hashes(plain.encode()).tolist())
        assert shared <= set(shingles.word_hashes(text.encode()).tolist())
        both = len(shingle_set(plain) & shingle_set(text))
        assert len(np.intersect1d(shingles.shingle_hashes(plain), shingles.shingle_hashes(text))) == both >= 292
    got = jaccard.join(table(spark, [(1, plain, None, None), (2, " ".join([*words[:100], stretch, *words[100:]]), None, None)])).collect()
    assert {r["component_id"] for r in got} == {1}


def test_jaccard_join(docs, corpus):
    sets = {}
    for i, t, _, _ in corpus:
        if i is not None:
            sets.setdefault(i, shingle_set(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = jaccard.join(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), root(r["doc_id"]))
    assert len({r["component_id"] for r in got}) <= len(got) - 20


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_prefix_keys_meet(rng, share):
    """Sets that link share a key, however many of their shingles are frequent."""
    pool = rng.integers(1, 1 << 62, 3000, np.uint64)
    frequent = rng.permutation(pool[rng.random(3000) < share])
    order = np.argsort(frequent)
    sorted_, rank = frequent[order], np.arange(len(frequent))[order]
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(4, 80))
        x = set(rng.choice(pool, n, replace=False).tolist())
        y = set(x)
        for _ in range(int(rng.integers(0, n // 5 + 2))):
            y.discard(rng.choice(sorted(y)))
        y |= set(rng.choice(pool, int(rng.integers(0, n // 6 + 1))).tolist())
        both = len(x & y)
        if not y or x == y or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        linked += 1
        a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
        assert set(jaccard.index_keys(a, sorted_, rank).tolist()) & set(jaccard.index_keys(b, sorted_, rank).tolist())
        narrow = [np.frombuffer(jaccard.sketch(s)[0], np.uint64) for s in (a, b)]
        assert int(np.bitwise_count(narrow[0] ^ narrow[1]).sum()) <= len(x ^ y)
    assert linked > 200


def test_large_buckets_go_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(base)
        w[i * 2] = f"x{i}"
        rows.append((i, " ".join(w), None, None))
    got = jaccard.join(table(spark, rows)).collect()
    sets = [shingle_set(t) for _, t, _, _ in rows]
    linked = any(100 * len(a & b) >= 80 * len(a | b) for a, b in itertools.combinations(sets, 2))
    assert linked and {r["component_id"] for r in got} == {0}


def test_components(spark, rng):
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(50)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_ranked(spark, rng):
    rows = [(("a", "b", None)[int(g)], int(v)) for g, v in rng.integers(0, 3, (200, 2))]
    df = spark.createDataFrame(rows, "g string, v long")
    got = ranked(df, ["g"], [F.col("v")], F.col("v").cast("int"), "r").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["r"], r["v"]))
    for found in by.values():
        found.sort()
        assert [k for k, _ in found] == list(range(1, len(found) + 1))
        assert [v for _, v in found] == sorted(v for _, v in found)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_block_of(spark, rng, n):
    bounds = sorted(rng.choice(1000, n, replace=False).tolist())
    rows = spark.createDataFrame([(int(v),) for v in rng.integers(-5, 1005, 300)] + [(None,)], "v long")
    for r in rows.select("v", block_of(F.col("v"), bounds).alias("b")).collect():
        assert r["b"] == (0 if r["v"] is None else sum(b <= r["v"] for b in bounds))


def test_fingerprints(docs, corpus):
    got = fingerprint.fingerprints(docs).collect()
    order = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t, _, _ in order]
    want = Counter()
    for k, (i, _, _, _) in enumerate(order):
        new = fingerprint.edited(texts[k], texts[(k + 1) % len(texts)])
        want[i, len(texts[k]), hashlib.sha256(new.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = defaultdict(set)
    for r in got:
        prints[next(t for i, t, _, _ in corpus if i == r["doc_id"])].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprint_estimates(rng):
    errors = []
    for n in (1, 3, 20, 400, 5000):
        for share in (0.0, 0.5, 0.9, 1.0):
            x = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            y = np.concatenate([x[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share), np.uint64) * np.uint64(2) + np.uint64(1)])
            x, y = np.unique(x), np.unique(y)
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(fingerprint.likeness(fingerprint.low_bits(x), fingerprint.low_bits(y)) - true)
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.25
    assert fingerprint.likeness(None, None) == 1.0 and fingerprint.packed(None) == ""


def test_language_id(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    assert all(len(p) <= langid.PROFILE for p in profiles.values())
    got = langid.predict(docs, profiles).collect()
    right = [r["lang"] == r["lang_pred"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(right) > 40 and np.mean(right) > 0.97
    odd = langid.predict(table(spark, [(1, None, None, None), (2, "12 !?", None, None), (3, "", None, None)]), profiles).collect()
    assert {(r["lang_pred"], r["score"]) for r in odd} == {("und", 0.0)}


def brute_grams(text):
    """N-grams (code points as one number) of a text, most frequent first, ties by code points."""
    point = lambda s: sum((1 if c == "_" else ord(c)) << (21 * (len(s) - 1 - k)) for k, c in enumerate(s))
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = f"_{word}_"
        for n in (1, 2, 3):
            found.update(point(g) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != "_")
    return found


@pytest.mark.parametrize("chars", [1 << 19, 40])
def test_ngram_counts(corpus, monkeypatch, chars):
    monkeypatch.setattr(langid, "_CHARS", chars)  # small: long texts go in pieces
    texts = ["ab, B", None, "ab", *(t for _, t, _, _ in corpus)]
    got = defaultdict(dict)
    for lo, _, text, gram, n in langid.counts(texts):
        for t, g, k in zip(text.tolist(), gram.tolist(), n.tolist(), strict=True):
            got[lo + t][g] = k
    assert [got[k] for k in range(len(texts))] == [dict(brute_grams(t)) for t in texts]


def test_out_of_place_distance(corpus, rng):
    """Predictions and scores against the definition."""
    texts = [t for _, t, _, _ in corpus]
    sizes = {"xx": range(0, 20), "yy": range(20, 40), "zz": range(40, len(texts))}
    profiles, ranked_ = {}, {}
    for lang, rows in sizes.items():
        total = sum((brute_grams(texts[i]) for i in rows), Counter())
        ranked_[lang] = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:50]]
        profiles[lang] = np.array(ranked_[lang], np.uint64)
    for text, (lang, score) in zip(texts, langid.classify(texts, profiles, 50), strict=True):
        own = [g for g, _ in sorted(brute_grams(text).items(), key=lambda x: (-x[1], x[0]))[:50]]
        far = {k: sum(abs(p.index(g) - i) if g in p else 50 for i, g in enumerate(own)) for k, p in ranked_.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert (lang, score) == ((best, pytest.approx(1 - far[best] / (50 * len(own)))) if own else ("und", 0.0))


def brute_links(rows):
    """Per row of (id, vector): how many other rows link, and its component; by all pairs of one length."""
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for _, v in rows]
    links, parent = Counter(), {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(rows[a][0]), root(rows[b][0])))
            parent[y] = x
    n = defaultdict(int)
    for k, (i, _) in enumerate(rows):
        n[i] += links[k]
    return {i: (n[i], root(i)) for i, _ in rows}


def test_vectors_of_one_hot_group(spark, rng, monkeypatch):
    """Groups far above a cell's bound, within and across cliques; no pair of a clique is made."""
    monkeypatch.setattr(vectors, "HOT", 8)
    d, made = 24, []
    centre = vectors._unit(rng.normal(size=(3, d)))
    rows = [(i, (centre[0] + 0.004 * rng.normal(size=d)).tolist()) for i in range(150)]  # one clique
    rows += [(200 + i, (centre[1] + 0.02 * rng.normal(size=d)).tolist()) for i in range(80)]  # wider: several, and vectors in none
    rows += [(300 + i, (centre[2] + 0.004 * rng.normal(size=d)).tolist()) for i in range(3)] + [(310 + i, rows[4][1]) for i in range(4)]
    rows += [(400 + i, rng.normal(size=d).tolist()) for i in range(300)]  # what the rotation is fitted to
    inner = vectors._linked

    def watched(pairs, reps, least):
        if least == vectors.THRESHOLD:
            made.append(pairs.where("a < 150 and b < 150").count())
        return inner(pairs, reps, least)

    monkeypatch.setattr(vectors, "_linked", watched)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    want = brute_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near(df).collect()}
    assert {i: got[i] for i in range(150)} == {i: want[i] for i in range(150)}
    assert {i: g[1] for i, g in got.items()} == {i: w[1] for i, w in want.items()}
    total = sum(n for n, _ in want.values())
    assert 0.95 * total <= sum(n for n, _ in got.values()) <= total and all(got[i][0] <= want[i][0] for i in want)
    assert made[0] < 0.2 * 150 * 149 / 2


@pytest.mark.parametrize("d", [16, 48])
def test_vectors(spark, rng, d):
    centre = rng.normal(size=(20, d))
    rows = [(i, (centre[i % 20] + 0.02 * rng.normal(size=d)).tolist()) for i in range(300)]  # far above the threshold or far below
    rows += [(300 + i, rows[3][1]) for i in range(5)] + [(310, rows[3][1]), (310, rows[3][1])]
    rows += [(320 + i, (centre[i % 2, :11] + 0.01 * rng.normal(size=11)).tolist()) for i in range(8)] + [(330, [2.0]), (331, [0.5]), (332, [-1.0])]  # other lengths
    odd = [(400, None), (401, [0.0] * d), (402, [float("nan")] * d), (403, [None] * d), (404, [float("inf")] * d), (405, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in [*rows, *odd]] + [(None, rows[0][1], 0)], "vec_id long, embedding array<float>, label int")
    got = vectors.near(df).collect()
    assert len(got) == len(rows) + len(odd) + 1
    want = brute_links(rows)
    for r in got:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["component_id"] is None
        else:
            n, root = want.get(r["vec_id"], (0, r["vec_id"]))
            assert (r["n_links"], r["component_id"], r["kept"]) == (n, root, r["vec_id"] == root), r


@pytest.mark.parametrize("d", [16, 32, 64, 128])
def test_recall_at_the_threshold(rng, d):
    """Pairs at a cosine of 0.95 to 0.96 that share a cell, up to one bit."""
    x = vectors._unit(rng.normal(size=(4000, d)))
    aside = rng.normal(size=x.shape)
    aside = vectors._unit(aside - (aside * x).sum(1, keepdims=True) * x)
    cosine = rng.uniform(0.95, 0.96, (4000, 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * aside
    width, count = vectors.tables(50_000)
    mean, project = vectors.fit(x, max(64, width * count))
    differ = ((x - mean) @ project >= 0) != ((y - mean) @ project >= 0)
    shared = (differ[:, : width * count].reshape(-1, count, width).sum(2) <= 1).any(1)
    assert (shared & (differ[:, :64].sum(1) <= vectors.MOST_BITS)).mean() >= 0.93
    assert vectors.tables(10**9)[0] > width


def test_packing_programme_of_256_lengths_beside_a_jvm(spark):
    """The programme ends in a Spark driver with default threads: nothing in it calls threaded linear algebra."""
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.choice(np.arange(1, 4096), 256, replace=False))
    demand = {int(s): int(n) for s, n in zip(sizes, rng.integers(1, 400, 256), strict=True)}
    plan = packing.cutting_stock(demand, 4096)
    made = Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 4096
        for s, n in pattern.items():
            made[s] += n * times
    assert made == demand
    fewest = sum(s * n for s, n in demand.items()) / 4096
    assert sum(times for _, times in plan) <= 1.03 * fewest + 20
    m = rng.normal(size=(60, 60))
    assert np.allclose(packing._inverse(m) @ m, np.eye(60)) and packing._inverse(np.ones((3, 3))) is None
