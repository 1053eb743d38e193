"""Phrases against brute force and SQL, with all ranks, few ranks and hashed numbers; tiles against a count."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.compare import duck, same
from tideframe.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, most=4, covered=80, scale=2_000_000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731,B023
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(q) for q, b in candidates.items()):
                continue
            score, k = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(8), []
    words = ["The", "of", "É", "日本", "a|b", "x\x1cy", "-", "w" * 300, "é"] + [f"w{i}" for i in range(30)]
    weights = np.array([1 / (i + 1) for i in range(len(words))])
    for _ in range(250):
        text = [str(w) for w in rng.choice(words, int(rng.integers(0, 60)), p=weights / weights.sum())]
        for _ in range(int(rng.integers(0, 3))):
            text.insert(int(rng.integers(0, len(text) + 1)), str(rng.choice(["New York", "new\tyork city hall", "a a a a a", "to be, or", "end.\nNew start\x0bnow", "rare" + str(rng.integers(1000))])))
        out.append((str(rng.choice(["en", "de", "Únd"])), " ".join(text)))
    return out + [(None, "und und und text"), (None, None), ("en", ""), ("en", " \n;"), ("fr", "seul"), ("en", "twice same"), ("en", "twice same")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    table = [(i % 7, lang, text, 1, 2, "x") for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id long, lang string, text string, rank long, n long, phrase string").repartition(3)


def found(table):
    return sorted(tuple(r) for r in table.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    same(queries.op12_collocations(spark, sf), duck(sf), collocations.ORACLE)


@pytest.mark.parametrize("how", [{}, {"head": 8, "filter_bits": 7, "side_bits": 1, "dense": 1, "buffer": 500}, {"head": 1, "filter_bits": 20, "buffer": 1}])
def test_brute_force(docs, rows, how):
    want = brute(rows, 4, 25)
    assert found(collocations.phrases(docs, least=4, top=25, **how)) == want
    assert len({r[0] for r in want}) > 2 and any(" " in r[2].replace(" ", "", 1) for r in want)


def test_shorter_phrases_and_no_rows(docs, rows):
    assert found(collocations.phrases(docs, least=5, top=3, most_words=2)) == brute(rows, 5, 3, most=2)
    assert found(collocations.phrases(docs, least=5, top=9, most_words=3, covered=50, scale=1000)) == brute(rows, 5, 9, most=3, covered=50, scale=1000)
    assert found(collocations.phrases(docs.where("doc_id < 0"))) == []


def test_tiles_count_every_pair():
    rng = np.random.default_rng(2)
    a, b = (np.where(rng.random(5000) < 0.8, rng.geometric(0.2, 5000) % 64, rng.integers(0, 9, 5000) | collocations._TAIL) for _ in range(2))
    tiles, got, dense = collocations.Tiles(head=64, side_bits=2, buffer=700, dense=4), Counter(), 0
    for lo in range(0, 5000, 90):
        for x, y, n in tiles.add(a[lo : lo + 90], b[lo : lo + 90]):
            got.update(dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)))
            dense = max(dense, len(tiles.tiles))
    for x, y, n in tiles.finish():
        got.update(dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)))
    assert got == Counter(zip(a.tolist(), b.tolist(), strict=True)) and dense > 1
