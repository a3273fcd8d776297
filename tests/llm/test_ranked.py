"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from eventloom.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(text):
    return TERM.findall((text or "").translate(str.maketrans(UP, LOW)))


def plain(docs, queries, k=20):
    counts = [(i, Counter(cut(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(Counter)
    for item, text in queries:
        asked[item].update(cut(text))
    out = {}
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 75 + (25 * c.total() * n) // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, x in terms.items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank] = (i, -s)
    return out


def corpus(rng, n, words=60, copies=0):
    docs = [(i, " ".join(f"W{int(rng.paretovariate(0.7)) % words}" for _ in range(rng.randrange(0, 80)))) for i in range(n)]
    return docs + [(n + j, docs[3][1]) for j in range(copies)]


def rows_of(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


def test_tables_of_all_shapes(spark, monkeypatch):
    rng = random.Random(4)
    docs = corpus(rng, 700, copies=150)  # many equal scores
    rng.shuffle(docs)
    queries = [(j, " ".join(f"w{rng.randrange(70)}" for _ in range(rng.randrange(0, 12)))) for j in range(30)] + [(5, "w1 w1 w2"), (100, docs[3][1]), (101, None), (102, "unknown")]
    want = plain(docs, queries)
    got = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")
    assert rows_of(ranked.ranked_search(*got)) == want
    # blocks of queries, and an index of all terms
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 600)
    monkeypatch.setattr(ranked, "VOCABULARY_BYTES", 0)
    assert rows_of(ranked.ranked_search(*got)) == want


def shards(docs, per_shard, vocabulary=None):
    packer, out = ranked._Packer(vocabulary, pa.int64()), []
    for i, text in docs:
        packer.add(i, text.encode())
        if len(packer.ids) == per_shard:
            out.append(packer.row().to_pylist()[0])
    return [*out, packer.row().to_pylist()[0]]


def test_search_opens_few_documents_and_all_that_tie():
    rng = random.Random(9)
    topics = [[f"t{k}x{j}" for j in range(40)] for k in range(40)]
    docs = [(i, " ".join(rng.choices(topics[rng.randrange(40)] + ["the"] * 5, k=60))) for i in range(8000)]
    docs += [(8000 + j, "rare words here") for j in range(500)]
    rng.shuffle(docs)
    queries = [(k, " ".join(rng.choices(topics[k], k=8)) + " the") for k in range(10)] + [(99, "rare words")]
    want = plain(docs, queries)
    made = shards(docs, 3000)
    n, total = sum(r["n_docs"] for r in made), sum(r["n_terms"] for r in made)
    df = Counter()
    for r in made:
        df.update(dict(zip(r["terms"], r["df"], strict=True)))
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    trees = [ranked.ShardTree(r, n, total, weights) for r in made]
    scored, got = 0, {}
    for item, text in queries:
        best = []
        for tree in trees:
            scored += tree.search([(t, c * weights[t]) for t, c in Counter(cut(text)).items()], best)
        got |= {(item, rank): (i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert got == want
    assert [got[99, r][0] for r in range(1, 21)] == list(range(8000, 8020))  # of equal scores the least ids
    assert scored < 0.15 * len(docs) * len(queries)


def test_bounds_hold_at_every_level():
    rng = random.Random(1)
    made = shards(corpus(rng, 500), 500)[0]
    tree = ranked.ShardTree(made, made["n_docs"], made["n_terms"], dict.fromkeys(made["terms"], 7))
    asked = ranked.np.array([rng.randrange(3) for _ in made["terms"]])
    below = None
    for level in range(len(tree.levels)):
        sums = tree._sums(asked, level, 0, len(tree.levels[level][2]) - 1)
        if below is not None:
            width = tree.widths[level]
            assert all(sums[i // width] >= x for i, x in enumerate(below))
        below = sums
    assert len(below) == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_edges(spark, kind):
    rows = [(None, "red green blue"), (1, "red"), (1, "red"), (2, None), (3, ""), (4, " ,.;\x00 "), (5, "Rot ÄÖ ÄÖ_red"), (6, "red " * 50000), (7, "a\x7fb 1é2")]
    rows = [(None if i is None else i if kind == "long" else f"k{i}", t, 1, "x") for i, t in rows]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, score int, item string")
    queries = spark.createDataFrame([(1, "RED red", 2), (None, "äö ÄÖ 1É2 1é2", 3), (2, None, None), (3, "", 1), (4, "zzz", 1)], "item_id int, text string, rank int")
    got = rows_of(ranked.ranked_search(docs, queries, k=3))
    # repeated rows are documents of their own; the row without an id only counts
    want = plain([(r[0], r[1]) for r in rows], [(1, "RED red"), (None, "äö ÄÖ 1É2 1é2")], k=3)
    assert got == want and len({r for i, r in got if i == 1}) == 3
    assert ranked.ranked_search(docs.limit(0), queries).count() == 0
    assert ranked.ranked_search(docs, queries.limit(0)).count() == 0
    same = ranked.ranked_search(docs, queries.withColumnRenamed("item_id", "doc_id"), item_column="doc_id")
    assert same.columns == ["item", "rank", "doc_id", "score"]
