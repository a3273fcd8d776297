"""Every operator: nulls in any column, empty and long texts, ties and repeated
rows, empty tables, further columns with clashing names."""

import hashlib
import random
import uuid
import zlib

import public_tokenizers
import pytest
from pyspark.sql import types as T

from eventloom.llm import chat, html_extract, media, mixing, ngram_join, packing, quality, secrets, sharding, token_counts
from eventloom.llm.common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, __row long, slot string"
LONG = "word and another word, then a third\n" * 20000
BIG = (1 << 60) + 1
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 3, 7, None, 5, "x"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "a", 3, 7, None, 5, "x"),
    (None, "a text without an id, but with words enough to be kept by the rules", "en", None, None, None, True, None, None),
    (2, None, None, "b", None, None, None, None, None),
    (3, "", "en", "b", 0, 0, False, 1, ""),
    (4, " \t\n ", "en", "a", 4, 4, False, 1, ""),
    (BIG, LONG, "en", "a", len(LONG), 1, None, 2, "y"),
    (6, "héllo \U0001f600 wörld", "fr", "\U0001f600", 5, 5, None, 3, "z"),
    (None, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids(rows):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"]) for r in rows)


ALL_IDS = sorted(-1 if r[0] is None else r[0] for r in ROWS)


def path(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def test_sharding(spark, docs, empty):
    rows = sharding.shard_records(docs, path(spark), 4).collect()
    assert ids(rows) == ALL_IDS
    for shard in {r["shard"] for r in rows}:
        places = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert places == list(range(len(places)))
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {16}
    assert next(r for r in rows if r["doc_id"] == 6)["text_crc32"] == zlib.crc32(ROWS[7][1].encode())
    kept = sharding.shard_records(docs, path(spark), 4, keep=["doc_id", "lang", "size", "slot"])
    assert kept.columns.count("slot") == 1 and kept.count() == len(ROWS)
    assert sharding.shard_records(empty, path(spark), 4).count() == 0


def test_token_counts(spark, docs, empty):
    import sentencepiece

    model_file = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows = token_counts.count_tokens(docs, model_file).collect()
    assert ids(rows) == ALL_IDS
    for r in rows:
        assert r["n_tokens"] == len(model.encode(r["text"] or "")) and r["n_bytes"] == len((r["text"] or "").encode())
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_counts.count_tokens(empty, model_file).count() == 0


def test_ngram_join(spark, docs, empty):
    rows = ngram_join.ngram_components(docs).collect()
    assert ids(rows) == ALL_IDS
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["component_id"] == 1 and by_id[1]["n_shingles"] == 8
    assert by_id[2]["n_shingles"] == 0 and by_id[2]["component_id"] == 2
    assert by_id[6]["n_shingles"] == 1
    assert ngram_join.ngram_components(empty).count() == 0
    left = ngram_join.one_per_component(docs).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [1, 2, 3, 4, 6, BIG]
    assert left[0].__fields__ == docs.columns


def test_packing(spark, docs, empty):
    file = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs, file, keep=["doc_id", "lang", "start"]).collect()
    assert ids([r for r in rows if r["piece"] == 0]) == ALL_IDS
    for q in {r["sequence_id"] for r in rows}:
        inside = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == q)
        at = 0
        for offset, length in inside:
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack_documents(empty, file, keep=["doc_id"]).count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert ids(rows) == ALL_IDS
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["size"] == len((r["text"] or "").split())
    assert {r["source"] for r in rows} == {"a", "b", None, "\U0001f600"}
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in rows) == sorted((str(r["doc_id"]), r["taken"]) for r in again)
    copies = mixing.mix_sources(docs, emit=True).count()
    assert copies == sum(r["copies"] for r in rows)
    assert mixing.mix_sources(empty).count() == 0


def test_quality(spark, docs, empty):
    rows = quality.quality_rules(docs, clean_text=True).collect()
    assert ids(rows) == ALL_IDS
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["kept"] and not by_id[2]["kept"] and not by_id[3]["kept"] and not by_id[4]["kept"]
    assert by_id[BIG]["n_repeat_words"] == by_id[BIG]["n_words"] == 140000 and by_id[BIG]["n_dup_lines"] == 19999
    assert by_id[BIG]["base_failed"]
    assert quality.quality_rules(empty).count() == 0


def test_secrets(spark, docs, empty):
    rows = secrets.scan_secrets(docs, redact=True).collect()
    assert ids(rows) == ALL_IDS
    assert all(r["n_hex"] == 0 and r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in rows)
    assert all(r["redacted_text"] == r["text"] for r in rows)
    assert secrets.scan_secrets(empty).count() == 0


def test_media(spark, docs, empty):
    at = path(spark)
    media.write_archives(docs, at)
    rows = media.media_features(media.read_archives(spark, at)).collect()
    assert ids(rows) == ALL_IDS
    for r in rows:
        if r["doc_id"] is not None:
            text = next(x[1] for x in ROWS if x[0] == r["doc_id"]) or ""
            assert r["payload_sha256"] == hashlib.sha256(media.padded(text.encode())).hexdigest()
    at = path(spark)
    media.write_archives(empty, at)
    assert media.media_features(media.read_archives(spark, at)).count() == 0


def test_html(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    good = "<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>A title here</h1><p>" + "Some words of the article, and more. " * 9 + "</p></article><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", good, "old", "old"), (1, "u", good, None, None), (2, None, None, None, None), (None, "u", "", None, None), (3, "u", "<<<>>><p", None, None), (4, "u", "<div>" * 3000 + "x" + "</div>" * 3000, None, None), (BIG, "u", "plain", None, None)]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    assert [r["text"] for r in got if r["page_id"] == 1] == ["A title here\n" + ("Some words of the article, and more. " * 9).strip()] * 2
    assert next(r for r in got if r["page_id"] == 2)["text"] == "" and next(r for r in got if r["page_id"] is None)["n_chars"] == 0
    assert any(r["page_id"] == BIG for r in got)
    assert html_extract.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, part string"
    rows = [(1, 1, "assistant", "b<\\>", "x"), (1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (None, 0, None, "t", None), (BIG, None, "assistant", "\U0001f600" * 50000, None), (2, 0, "a>\n<b", "", None)]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {1, None, BIG, 2}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256("user\n\nuser\n\nassistant\nb<\\>\n".encode()).hexdigest()
    assert got[BIG]["loss_chars"] == 50000 and got[1]["loss_chars"] == 4
    assert got[2]["turns_sha256"] == hashlib.sha256(b"a>\n<b\n\n").hexdigest()
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_chat_parts_in_any_order(spark):
    said = [("assistant" if i % 2 else "user", f"<{i}> \\ \u00e9") for i in range(20)]
    turns = spark.createDataFrame([(c, i, *said[i]) for c in (1, None) for i in range(20)], "conv_id long, turn long, role string, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        parts = chat.format_conversations(turns).collect()
        assert sum(p["n_turns"] for p in parts) == 40 and len(parts) > 2
        stored = spark.createDataFrame(parts[::-1], chat.PART_SCHEMA)
        got = chat.read_back(stored, ordered=False).collect()
        with pytest.raises(Exception, match="out of order"):
            chat.read_back(stored.filter("part != 0"), ordered=False).collect()
    finally:
        spark.conf.set(key, before)
    whole = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    learned = hashlib.sha256("".join(b for a, b in said if a == "assistant").encode()).hexdigest()
    assert sorted((g["conv_id"] or 0, g["n_turns"], g["turns_sha256"], g["loss_sha256"]) for g in got) == [(c, 20, whole, learned) for c in (0, 1)]


def test_types_survive(spark, docs):
    kept = secrets.scan_secrets(docs)
    assert kept.schema["doc_id"].dataType == T.LongType()
    assert BIG in {r["doc_id"] for r in kept.collect()}


CLASHING = ["SIZE", "Spans", "__source", "__draw", "__key", "__words", "__bit", "row", "kept", "HOST", "line", "text2", "N_TOKENS", "Copies", "Virtual_Slot", "Piece", "component_ID", "bucket", "salt", "a.b"]


def _operators(spark):
    tokenizer, model = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return {
        "op1": lambda d: html_extract.extract_main_text(d, "text"),
        "op2": lambda d: sharding.shard_records(d, path(spark), 4, keep=d.columns),
        "op3": lambda d: token_counts.count_tokens(d, model),
        "op4": ngram_join.one_per_component,
        "op5": lambda d: packing.pack_documents(d, tokenizer),
        "op6": mixing.mix_sources,
        "op6 rows": lambda d: mixing.mix_sources(d, emit=True),
        "op9": secrets.scan_secrets,
        "op10": quality.quality_rules,
        "op10 texts": lambda d: quality.clean_documents(d),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op6 rows", "op9", "op10", "op10 texts"])
@pytest.mark.parametrize("id_type", ["long", "string"])
def test_columns_with_any_names_pass_through(spark, name, id_type):
    schema = f"doc_id {id_type}, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING)
    texts = [None, "", "one two three four five six seven eight nine ten eleven twelve", "one two three four five six seven eight nine ten eleven twelve", "something else that has words enough to stay in the table by itself"]
    rows = [(str(i) if id_type == "string" else i, t, "ab"[i % 2], *[100 * i + k for k in range(len(CLASHING))]) for i, t in enumerate(texts)]
    out = _operators(spark)[name](spark.createDataFrame(rows, schema))
    low = [c.lower() for c in out.columns]
    assert len(set(low)) == len(low)
    passed = [(k, c) for k, c in enumerate(CLASHING) if c in out.columns and out.schema[c].dataType == T.IntegerType()]
    replaced = {c.lower() for c in CLASHING} - {c.lower() for _, c in passed}
    assert replaced <= set(low) and (not replaced or name not in ("op1", "op4", "op10 texts"))
    for r in out.collect():
        assert all(r[c] == 100 * int(r["doc_id"]) + k for k, c in passed), name


def test_media_takes_ids_of_any_type(spark):
    at = path(spark)
    media.write_archives(spark.createDataFrame([("a/b", "x"), ("null", "y"), (None, "z"), ("", "w")], "doc_id string, text string"), at)
    assert {r["doc_id"] for r in media.media_features(media.read_archives(spark, at), id_type="string").collect()} == {"a/b", "null", None, ""}


def test_media_with_long_ids_in_ranges_of_any_size(spark):
    r = random.Random(3)
    rows = [("x" * r.choice([1, 60, 105, 3000]) + str(i), "t" * r.choice([0, 10, 5000])) for i in range(60)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for range_bytes in (512, 4096, 1 << 20):
        folder = path(spark)
        media.write_archives(docs, folder)
        spark.dataSource.register(media.MediaArchiveSource)
        members = spark.read.format("media_archive").option("rangeBytes", range_bytes).load(folder) if range_bytes < 1 << 20 else media.read_archives(spark, folder)
        got = media.media_features(members, id_type="string").select("doc_id", "n_bytes").collect()
        assert sorted(map(str, ((g["doc_id"], g["n_bytes"]) for g in got))) == sorted(map(str, ((i, len(t)) for i, t in rows)))


def test_chat_with_ids_of_any_type_and_long_texts(spark):
    long = "ab<c>\\ " * 300_000
    rows = [("b", 0, "user", long), ("b", 1, "assistant", "ok"), ("a" * 200, 0, "assistant", "x"), (None, 0, "user", None), (None, 1, "assistant", "<")]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in chat.read_back(chat.format_conversations(turns)).collect()}
    digest = lambda *said: hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
    assert got == {
        "b": (2, digest(("user", long), ("assistant", "ok")), 2),
        "a" * 200: (1, digest(("assistant", "x")), 1),
        None: (2, digest(("user", ""), ("assistant", "<")), 1),
    }


def test_chat_layout_by_slices_of_any_size(monkeypatch):
    r = random.Random(1)
    for size in (1, 2, 7, 50, 1 << 20):
        monkeypatch.setattr(chat, "SLICE", size)
        for _ in range(60):
            n = r.randint(0, 6)
            roles = ["".join(r.choice("<>\\\nab/turn ") for _ in range(r.randint(0, 8))) for _ in range(n)]
            texts = ["".join(r.choice("<>\\\n/turné\U0001f600 ") for _ in range(r.choice([0, 0, 1, 5, 30]))) for _ in range(n)]
            buffer, _, begin, end = chat.assemble(roles, texts)
            assert [(a.decode(), b.decode()) for a, b in chat.parse_part(buffer.tobytes())] == list(zip(roles, texts, strict=True))
            escaped = [t.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>") for t in texts]
            assert [buffer[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)] == escaped
