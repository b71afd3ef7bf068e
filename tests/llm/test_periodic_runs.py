import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from odd import ODD, no_documents, odd_documents

from termscale.llm import periodic_runs as R
from termscale.llm.queries import op12_periodic_runs
from termscale.llm.recompression import Grammar


def runs_by_definition(words, least=24):
    """Every period from 1 on, every longest stretch that keeps it; a stretch found before has a smaller period."""
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda run: (run[0], run[2]))


def common(words, i, j):
    n = 0
    while max(i, j) + n < len(words) and words[i + n] == words[j + n]:
        n += 1
    return n


def test_extensions_both_ways():
    draw = random.Random(5)
    for trial in range(120):
        k, n = draw.choice([1, 2, 3, 5]), draw.randint(2, 50)
        words = [0, *[1 + draw.randrange(k) for _ in range(n)], k + 1]
        pairs = [(i, j) for i in range(1, n + 1) for j in range(1, n + 1) if i != j]
        a, b = (np.array(side) for side in zip(*pairs, strict=True))
        made = Grammar(np.array(words), seed=trial)
        assert made.extensions(a, b).tolist() == [common(words, i, j) for i, j in pairs]
        back = words[::-1]
        assert made.mirrored().extensions(a, b).tolist() == [common(back, i, j) for i, j in pairs]


def repetitive(draw):
    words = [draw.randrange(draw.choice([1, 2, 3, 8, 40])) for _ in range(draw.randint(0, 120))]
    for _ in range(draw.randint(0, 3)):
        if words:
            start, period = draw.randrange(len(words)), draw.randint(1, 12)
            for i in range(start + period, min(len(words), start + draw.randint(1, 60))):
                words[i] = words[i - period]
    return words


@pytest.mark.parametrize("least", [3, 6, 24])
def test_runs_by_definition(least, monkeypatch):
    draw = random.Random(least)
    for trial in range(150):
        monkeypatch.setattr(R, "GRID", draw.choice([1, 20, 1 << 20]))
        texts = [repetitive(draw) for _ in range(draw.randint(1, 6))]
        found = R.runs_of([np.array(text, np.int64) for text in texts], least)
        assert found == [runs_by_definition(text, least) for text in texts], trial


def test_texts_that_are_hard():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    hard = [b, [7] * 5000, list(range(50)) * 60, [*[1] * 30, 2] * 40, list(range(4000))]
    assert R.runs_of([np.array(text) for text in hard]) == [runs_by_definition(text) for text in hard]
    assert R.runs_of([np.zeros(300_000, np.int64)]) == [[(0, 300_000, 1)]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_definition(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=(None, None, None))
    milli = best[1] and 1000 * best[1] // best[2]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *best, milli, *(hashlib.sha256(x).hexdigest() for x in (lines.encode(), kept)))


def test_table(spark):
    rows = op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, rows)) == sorted(expected(*doc) for doc in docs)
    assert sum(row.n_runs > 0 for row in rows) > 5


def test_odd_rows(spark, tmp_path):
    rows = [*ODD, *[(i, "a b c " * 20 + "d " * i) for i in range(100, 130)], (None, "x\x0by\x85 z " * 12)]
    odd_documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(row) for row in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted([expected(*row) for row in rows], key=str)
    assert R.periodic_runs(no_documents(spark)).count() == 0


def test_long_text_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(R, "AT_ONCE", 10)
    text = "some words again " * 30_000
    made = R.periodic_runs(spark.createDataFrame([(1, text), (2, "no")], "doc_id int, text string")).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in made] == [
        (1, [(0, 90_000, 3)], "some words again"),
        (2, [], "no"),
    ]
