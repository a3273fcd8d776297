"""Steps whose cost must not grow faster than their input."""

from collections import Counter

from pyspark.sql import functions as F

from eventloom import snapshots
from eventloom.functions.text import DENSE, term_counts, tokens
from eventloom.operators import diagnostics, segments, term_index
from eventloom.operators.segments import SegmentedIndex
from eventloom.operators.term_index import TermIndex
from eventloom.queries import whole_tables
from eventloom.schema import conform
from eventloom.snapshots import Snapshots
from eventloom.sources import frontiers, jsonl

SF = "/root/testdata/sf0.001"
TEXTS = ["ab AB äb ab2 xжy", "", None, "ж" * 100_000, "日本語 ab" * 20, "x" * 70 + " x", "a-b_cͅ ª²ʰ \U00010400y"]


def test_terms_are_counted_in_their_row(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "event_id long, body string").withColumn("tokens", tokens(F.coalesce("body", F.lit(""))))
    plain = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(rf"([{DENSE}]|[[\p{{IsAlphabetic}}\p{{N}}]&&[^{DENSE}]]+)"), F.lit(0))
    got = rows.select("body", "tokens", term_counts(F.col("tokens")).alias("terms"), plain.alias("runs"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert {t["term"]: t["tf"] for t in r["terms"]} == Counter(r["tokens"]) and [t["term"] for t in r["terms"]] == sorted(set(r["tokens"]))
        chunks = lambda run: [run] if len(run) <= 32 else [run[i : i + 32] for i in range(0, len(run) - 8, 24)]
        assert r["tokens"] == [c.lower() for run in r["runs"] for c in chunks(run)]


def test_index_tasks_stay_small_as_postings_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(term_index, "POSTINGS_PER_TASK", 10)
    events = spark.range(4000).select(F.col("id").alias("event_id"), F.lit("one word").alias("body"))
    TermIndex.write(events, str(tmp_path / "index"))
    files = spark.read.parquet(str(tmp_path / "index" / "postings")).groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] < 500  # 4,000 postings a term: more files, not larger ones


def test_scan_counters_cut_texts_once(spark, monkeypatch):
    plans, scan = [], diagnostics.lexical_scan
    monkeypatch.setattr(diagnostics, "lexical_scan", lambda events, *rest: plans.append(events._jdf.queryExecution().optimizedPlan().toString()) or scan(events, *rest))
    whole_tables.lexical_scan_counters(spark, SF).collect()
    assert "regexp_extract_all" not in plans[0]


def test_tasks_of_publications_and_segments_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FOLDER_BYTES", 2_000)
    monkeypatch.setattr(segments, "POSTINGS_PER_TASK", 500)
    store = Snapshots(spark, str(tmp_path / "store"))
    n = F.col("id")
    rows = spark.range(2000).select(F.format_string("e%06d", n).alias("event_id"), F.lit("one").alias("source_key"), F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), n % 40), F.concat(F.lit("r"), n)).alias("body"), F.lit("message").alias("event_type"), F.lit("selected").alias("policy_status"), F.lit("s").alias("session_id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.publish(replace=conform(rows))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.read().groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 1500  # about 25 kB of text of one source
    index = SegmentedIndex.update(store)
    blocks = SegmentedIndex._read_blocks(store, [s.name for s in index.segments])
    assert index.written == 6000 == blocks.agg(F.sum("n")).first()[0]
    files = blocks.groupBy(F.input_file_name(), "bucket").agg(F.sum("n").alias("n"))
    assert files.agg(F.max("n")).first()[0] < 1500 and files.count() > segments.BUCKETS  # "all" has 2,000 postings
    assert index.document_frequencies(["all", "w7"]) == {"all": 2000, "w7": 50}
    found = [r["event_id"] for r in index.best(["all", "w7"], 10).pool.collect()]
    assert sorted(found) == [f"e{i:06d}" for i in range(7, 400, 40)]


def test_files_are_read_by_tasks_of_like_bytes(spark, tmp_path, monkeypatch):
    """Neither one task for all files, as ranges are small rows, nor one for each."""
    for i in range(60):
        (tmp_path / f"{i:02}.jsonl").write_bytes(b"".join(b'{"file": %d, "line": %d}\n' % (i, n) for n in range(20)))
    for module in (frontiers, jsonl):
        monkeypatch.setattr(module, "TASK_BYTES", 6_000, raising=False)
        monkeypatch.setattr(module, "OPEN_BYTES", 500, raising=False)
    tasks = lambda rows: rows.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("file").alias("files")).collect()
    listed = frontiers.listed(spark, str(tmp_path))
    spans = listed.select("file", F.lit(0).cast("long").alias("floor"), F.col("size").alias("stop"))
    lines, records = frontiers.lines(spans, str(tmp_path)), jsonl.read_records(spark, str(tmp_path))
    assert len(tasks(lines)) >= 6 and len(tasks(records)) == 2  # tasks of records are planned by another process
    parts = jsonl.BoundedJsonlReader({"path": str(tmp_path), "rangeBytes": "300"}).partitions()
    assert 6 <= len(parts) <= 30 and len({r.file for p in parts for r in p.ranges}) == 60
    rows = lambda found: sorted((r["file"], r["offset"], r["value"]) for r in found.collect())
    assert rows(lines) == rows(records) and len(rows(lines)) == 1200
    seen = frontiers.certified(listed.withColumns({"frontier": F.lit(None).cast("long"), "prefix_hash": F.lit(None).cast("string")}), str(tmp_path))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan and seen.filter("change = 'cold'").count() == 60


def test_files_of_a_batch_grow_with_rows_not_with_sources(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    n = F.col("id")
    rows = spark.range(3000).select(F.concat(F.lit("e"), n).alias("event_id"), F.concat(F.lit("s"), n % 300).alias("source_key"), F.lit("s").alias("session_id"), n.alias("event_sequence"), F.lit("message").alias("event_type"), F.concat(F.lit("w"), n).alias("body"))
    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda body: made.add(1) or body)
    store.publish(replace=rows.withColumn("body", counted("body")).filter("event_sequence < 1500"))
    assert made.value == 1500  # events are made once
    store.publish(append=rows.filter("event_sequence >= 1500"))
    assert store.read().select(F.input_file_name()).distinct().count() <= 4
    assert store.read().count() == 3000 and store.duplicates().count() == 0
    store.publish(replace=rows.filter("source_key = 's7' AND event_sequence < 10"), delete=["s8"])
    left = store.read().groupBy("source_key").count().collect()
    assert len(left) == 299 and {r["count"] for r in left if r["source_key"] != "s7"} == {10}
    assert [r["event_id"] for r in store.read(sources=["s7"]).collect()] == ["e7"] and store.read(sources=["s8"]).count() == 0
    many = [f"s{i}" for i in range(200)]
    assert store.read(sources=many).count() == 198 * 10 + 1
    index = SegmentedIndex.update(store)
    assert index.n_docs == 2981 and index.document_frequencies(["w307", "w308", "w309", "w7"]) == {"w309": 1, "w7": 1}
