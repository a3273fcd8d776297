"""Periodic runs against a plain search by every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from eventloom.llm import runs
from eventloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, min_length=24):
    """All (start, length, smallest period), by comparing each word with the one a period later."""
    found = {}
    for q in range(len(words) // 3, 0, -1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, 3 * q):
                found[i, j + q - i] = q
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_random_words():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            ws = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.randrange(120))]
            if rng.random() < 0.6 and len(ws) > 10:
                a, p = rng.randrange(len(ws)), rng.randrange(1, 12)
                ws = ws[:a] + [ws[a + i % min(p, len(ws) - a)] for i in range(rng.randrange(80))] + ws[a:]
            docs.append(ws)
        least = rng.choice([24, 24, 9, 6])
        for ws, row in zip(docs, runs._chunk(docs, least), strict=True):
            found = plain_runs(ws, least)
            assert list(zip(*row[1:4], strict=True)) == found
            assert row[4] == collapsed(ws, found)


def test_masking_leaves_words_of_runs_only():
    rng = random.Random(2)
    words = [str(rng.randrange(10**6)) for _ in range(3000)]
    words[1000:1000] = [f"p{i % 9}" for i in range(31)]
    row = runs._chunk([words], 24)[0]
    assert row[1:4] == ([1000], [31], [9])
    assert row[6] == 31  # nothing else was searched


def test_equal_words_of_neighbouring_documents_do_not_meet():
    half = ["x"] * 23
    assert [r[1] for r in runs._chunk([half, half, ["x"] * 24], 24)] == [[], [], [0]]


def test_long_run_and_fibonacci_word():
    a, b = ["a"], ["a", "b"]
    while len(b) < 3000:
        a, b = b, b + a
    for words in (["w"] * 60_000, b[:3000]):
        row = runs._chunk([words], 24)[0]
        found = plain_runs(words) if len(words) < 5000 else [(0, 60_000, 1)]
        assert list(zip(*row[1:4], strict=True)) == found


def test_ranks_compare_like_words(monkeypatch):
    monkeypatch.setattr(runs, "MAX_LEVEL", 3)  # long comparisons in steps of 8 words
    words = [f"{i % 40}" for i in range(1000)] + ["end"] + [f"{i % 7}" for i in range(300)]
    assert list(zip(*runs._chunk([words], 24)[0][1:4], strict=True)) == plain_runs(words)


def test_min_overlap():
    assert runs.min_overlap() == 16
    assert min(n - q for n in range(24, 400) for q in range(1, n // 3 + 1)) == 16


def test_query_over_the_whole_table(spark):
    docs = {r["doc_id"]: WORD.findall(r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(docs)
    some = 0
    for r in rows:
        words = planted(docs[r["doc_id"]], r["doc_id"])
        found = plain_runs(words) if len(words) < 1500 else list(zip(*runs._chunk([words], 24)[0][1:4], strict=True))
        some += bool(found)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert some > 20


@pytest.mark.parametrize("text", [None, "", " \n\t ", "w " * 23, "w " * 24, "é x y " * 30, "a\x1cb " * 40])
def test_edges(spark, text):
    docs = spark.createDataFrame([(None, text, 1, "p"), (7, text, 2, None), (7, text, 2, None)], "doc_id long, text string, collapsed int, n_words string")
    found = runs.periodic_runs(docs, keep=["doc_id"])
    rows = found.select("doc_id", "collapsed", *runs.digests(found)).collect()
    words = WORD.findall(text or "")
    expected = plain_runs(words)
    assert [r["doc_id"] for r in sorted(rows, key=str)] == sorted([7, 7, None], key=str)
    assert all(r["n_runs"] == len(expected) and r["collapsed"] == collapsed(words, expected) for r in rows)
    assert runs.periodic_runs(docs).columns == ["doc_id", "text", *runs.ADDED]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_planting_in_sql_and_by_hand(spark):
    rows = [(i, " ".join(str(j) for j in range(i % 60))) for i in range(500)] + [(None, "x y"), (3, None), (38, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", "text", runs.planted(docs.text, docs.doc_id).alias("planted")).collect()
    for r in got:
        words = WORD.findall(r["text"] or "")
        assert WORD.findall(r["planted"] or "") == (words if r["doc_id"] is None else planted(words, r["doc_id"]))
    assert np.mean([r["planted"] != r["text"] for r in got]) > 0.05
