"""The pipeline, stage by stage on each one's own input, against plain versions."""

import uuid
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from eventloom.llm import mixing, secrets
from eventloom.llm.common import shared_dir

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    for rows in steps[:5]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(steps):
    kept = brute.kept_documents([(r["text"], r["source"]) for r in steps[0]])
    wanted = {}
    for i, r in enumerate(steps[0]):
        if kept[i][0]:
            lines = r["text"].split("\n")
            wanted[r["doc_id"]] = "\n".join(x for x in lines if not (brute.WORD.search(x) and brute.normal_line(x) in kept[i][1]))
    assert {r["doc_id"]: r["text"] for r in steps[1]} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in steps[1])


def test_near_duplicate_stage(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1]]
    component, _ = brute.near_components(rows)
    assert sorted(r["doc_id"] for r in steps[2]) == sorted({component[i] for i in range(len(rows))})
    assert {r["doc_id"]: r["text"] for r in steps[2]}.items() <= dict(rows).items()


def test_secret_stage(steps):
    was = {r["doc_id"]: r["text"] for r in steps[2]}
    now = {r["doc_id"]: r["text"] for r in steps[3]}
    assert set(was) == set(now)
    for d, text in was.items():
        spans = secrets.base_spans(text)
        assert now[d] == secrets.redacted(text, sorted(spans + secrets.confirmed_spans(text)))
        assert (now[d] == text) == (not spans)


def test_mixing_stage(steps, spark):
    rows = spark.createDataFrame(steps[3])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(rows).collect()}
    assert Counter(r["doc_id"] for r in steps[4]) == Counter({d: n for d, n in copies.items() if n})


def test_packing_stage_and_run(steps, spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = Counter()
    for r in steps[4]:
        lengths[r["doc_id"]] += len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
    packed = Counter()
    fill = Counter()
    for r in steps[5]:
        packed[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]] += r["length"]
    assert packed == lengths and max(fill.values()) <= 2048
    assert len(fill) <= 1.03 * np.ceil(sum(lengths.values()) / 2048) + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = corpus_pipeline.run(spark, SF)
    assert Counter(tuple(r[c] for c in columns) for r in again.select(columns).collect()) == Counter(tuple(r[c] for c in columns) for r in steps[5])
