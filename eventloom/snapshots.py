"""Immutable generations of events on plain Parquet, published atomically.

A generation is a manifest: for every source the parts of batches that hold its
rows, with counts and an order-free content sum. A publication writes one batch, a
folder with the rows of changed sources only; unchanged ones keep their parts. A
file holds many small sources, so files grow with the rows and not with the
sources, and rows of a batch that a generation doesn't refer to are passed over. A generation has one
successor: who publishes claims it by creating a file that must not exist, so of
two publishers one fails and none is lost. The pointer to the active generation
is one small file, replaced after the new manifest has been verified; where a
file system can't rename over a file, readers that find none look again. Readers
resolve the pointer once and stay with that generation.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.counts import content_sums
from .schema import CORE_EVENT, conform

GRACE_ABSENCES = 3
CLAIM_SECONDS = 600  # a claim that led to nothing may be taken over after this
FOLDER_EVENTS = 1 << 20  # events that one task writes
FOLDER_BYTES = 32 << 20  # and bytes of their texts
FEW_SOURCES = 100  # so many keys are looked for by the files' statistics
VERDICTS = "source_key string, verdict string, reason string, events long, added long"


class LostClaim(RuntimeError):
    """Another publisher took over the claim on a generation."""


@dataclass
class SourceState:
    """What a manifest keeps of one source; a path is a batch's folder and, below it, the name of the source's part."""

    paths: list[str]
    events: int
    content_sum: str
    frontier: int = 0
    prefix_hash: str = ""
    absences: int = 0


@dataclass
class Generation:
    parent: str | None
    sources: dict[str, SourceState] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def text(self) -> str:
        body = {"parent": self.parent, "notes": self.notes, "sources": {k: vars(v) for k, v in sorted(self.sources.items())}}
        return json.dumps(body, sort_keys=True)

    @property
    def id(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()[:32]

    @staticmethod
    def parse(text: str) -> Generation:
        body = json.loads(text)
        return Generation(body["parent"], {k: SourceState(**v) for k, v in body["sources"].items()}, body["notes"])


class Snapshots:
    """A store of generations below ``root``, a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # -- small files -------------------------------------------------------
    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Written aside and renamed, so that readers see the old or the new file."""
        aside = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._path(f"{self.root}/{name}")
        if not self._fs.rename(aside, target):  # file systems that don't replace
            self._fs.delete(target, False)
            self._fs.rename(aside, target)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def work_path(self, name: str) -> str:
        """A new path below the root for a table that outlives no publication; ``reclaim`` deletes them."""
        return f"{self.root}/work/{name}-{uuid.uuid4().hex}"

    # -- reading -----------------------------------------------------------
    def pointer(self) -> dict | None:
        text = self._read("pointer.json")
        for _ in range(20):
            if text or not self._listed("generations"):
                break
            time.sleep(0.1)  # it is being replaced
            text = self._read("pointer.json")
        return json.loads(text) if text else None

    def active(self) -> str | None:
        pointer = self.pointer()
        return pointer["active"] if pointer else None

    def generation(self, generation_id: str | None = None) -> Generation:
        found = generation_id or self.active()
        text = self._read(f"generations/{found}.json") if found else None
        if text is None:
            if generation_id:
                raise ValueError(f"no generation {generation_id}")
            return Generation(None)
        return Generation.parse(text)

    def read(self, generation_id: str | None = None, sources: list[str] | None = None) -> DataFrame:
        """Events of one generation, or only those of ``sources``."""
        states = self.generation(generation_id).sources
        wanted = states.keys() if sources is None else states.keys() & set(sources)
        return self._parts([(k, p) for k in sorted(wanted) for p in states[k].paths]).select(*CORE_EVENT.names)

    def _parts(self, parts: list[tuple[str, str]]) -> DataFrame:
        """The rows of parts (source_key, path), each with its ``path``."""
        if not parts:
            return self.spark.createDataFrame([], CORE_EVENT).withColumn("path", F.lit(""))
        batch = lambda path: path.split("/")[1].removeprefix("batch=")
        held = self.spark.createDataFrame([(batch(p), k, p) for k, p in parts], "batch string, source_key string, path string")  # entries of a manifest
        folders = sorted({p.rsplit("/", 1)[0] for _, p in parts})
        schema = T.StructType([*CORE_EVENT.fields, T.StructField("batch", T.StringType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/{f}" for f in folders])
        if len(keys := {k for k, _ in parts}) <= FEW_SOURCES:
            rows = rows.filter(F.col("source_key").isin(*sorted(keys)))
        return rows.join(F.broadcast(held), ["batch", "source_key"])

    def frontiers(self, generation_id: str | None = None) -> DataFrame:
        """(source_key, frontier, prefix_hash) of the sources that were read by frontier."""
        states = self.generation(generation_id).sources
        return self.spark.createDataFrame([(k, s.frontier, s.prefix_hash) for k, s in states.items() if s.prefix_hash], "source_key string, frontier long, prefix_hash string")

    def verdicts(self, generation_id: str | None = None) -> DataFrame:
        """What became of each route of the publication that made a generation."""
        return self.spark.read.schema(VERDICTS).parquet(f"{self.root}/verdicts/{generation_id or self.active()}")

    # -- writing -----------------------------------------------------------
    def _write_rows(self, events: DataFrame) -> tuple[str, DataFrame]:
        """Write rows below one new folder, sources side by side; the folder and what it holds."""
        batch, made = f"data/batch={uuid.uuid4().hex}", self.work_path("rows")
        conform(events).write.parquet(made)  # made once, then measured and dealt
        rows = self.spark.read.schema(CORE_EVENT).parquet(made)
        text = F.coalesce(F.octet_length("body"), F.lit(0)) + F.coalesce(F.octet_length("structured_content"), F.lit(0)) + F.coalesce(F.octet_length("result_text"), F.lit(0))
        share = F.greatest(F.count(F.lit(1)) / FOLDER_EVENTS, F.sum(text) / FOLDER_BYTES)
        large = F.when(F.col("share") > 1, F.struct("source_key", F.ceil("share").alias("__tasks")))
        sizes = rows.groupBy("source_key").agg(share.alias("share")).agg(F.sum("share").alias("tasks"), F.collect_list(large).alias("large")).first()  # fewer large ones than tasks
        # A large source is written by as many tasks as it needs, small ones share a task.
        spread = self.spark.createDataFrame(sizes["large"], "source_key string, __tasks long")
        dealt = rows.join(F.broadcast(spread), "source_key", "left").withColumn("__task", F.coalesce(F.pmod(F.xxhash64("event_id"), F.col("__tasks")), F.lit(0)))
        dealt.repartition(max(1, math.ceil(sizes["tasks"] or 0)), "source_key", "__task").drop("__tasks", "__task").sortWithinPartitions("source_key", "session_id", "event_sequence").write.parquet(f"{self.root}/{batch}")
        self._fs.delete(self._path(made), True)
        return batch, self.spark.read.schema(CORE_EVENT).parquet(f"{self.root}/{batch}")

    def _stage(self, events: DataFrame) -> dict[str, SourceState]:
        batch, written = self._write_rows(events)
        self._refuse_repeated(written)
        facts = written.groupBy("source_key").agg(F.count(F.lit(1)).alias("events"))
        sums = content_sums(written)
        states = {}
        for r in facts.join(sums, "source_key").withColumn("part", F.sha2("source_key", 256)).collect():  # one row a source
            states[r["source_key"]] = SourceState([f"{batch}/{r['part']}"], r["events"], r["content_sum"])
        return states

    @staticmethod
    def _refuse_repeated(events: DataFrame) -> None:
        """An identity that stands for two events is an error, never repaired."""
        found = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(3).collect()
        if found:
            raise ValueError(f"events with the same id: {[r['event_id'] for r in found]}")

    def _claim(self, base: str | None, claimant: str) -> None:
        """Become the one successor of ``base``, or fail."""
        path = self._path(f"{self.root}/claims/{base or 'first'}.json")
        for _ in range(2):
            try:
                stream = self._fs.create(path, False)
                stream.write(bytearray(json.dumps({"by": claimant, "ms": int(time.time() * 1000)}).encode()))
                stream.close()
                self._keep_claim(base, claimant)  # two that took over one old claim: the later one has it
                return
            except LostClaim:
                raise
            except Exception as error:  # the file system's own kind of "exists already"
                if not self._fs.exists(path):
                    raise
                old = time.time() * 1000 - self._fs.getFileStatus(path).getModificationTime() > CLAIM_SECONDS * 1000
                if not old or self.active() != base:
                    raise RuntimeError("another generation was published in between") from error
                self._fs.delete(path, False)
        raise RuntimeError("another generation was published in between")

    def _keep_claim(self, base: str | None, claimant: str) -> None:
        claim = self._read(f"claims/{base or 'first'}.json")
        if claim is None or json.loads(claim)["by"] != claimant:
            raise LostClaim("another generation was published in between")

    def _commit(self, base_id: str | None, states: dict[str, SourceState], staged: list[str], notes: dict[str, str] | None) -> str:
        """Make ``states`` the generation after ``base_id``; ``staged``: the parts that are new."""
        new = Generation(base_id, states, {"published_ms": str(int(time.time() * 1000)), **(notes or {})})
        missing = [f for f in sorted({p.rsplit("/", 1)[0] for p in staged}) if not self._fs.exists(self._path(f"{self.root}/{f}"))]
        if missing:
            raise RuntimeError(f"missing folders: {missing[:3]}")
        claimant = uuid.uuid4().hex
        self._claim(base_id, claimant)
        self._write(f"generations/{new.id}.json", new.text())
        self._keep_claim(base_id, claimant)  # a publisher that was slow and overtaken moves nothing
        self._write("pointer.json", json.dumps({"active": new.id, "previous": base_id}))
        return new.id

    def publish_routes(self, events: DataFrame, routes: DataFrame, checks: dict[str, Column] | None = None, notes: dict[str, str] | None = None) -> tuple[str | None, DataFrame]:
        """Publish what is sound: every source stands or falls by itself.

        ``routes``: source_key, change (cold, replace or append), frontier and
        prefix_hash after it, known_frontier and known_hash that an append starts
        from. ``checks``: name to a condition that every event has to meet.
        A source fails if an event breaks a check, if an id stands in it twice, in
        its rows that an append keeps or in a source of the batch that comes before
        it by key, or if its frontier isn't the active generation's any more; it
        keeps the rows and the frontier it had. Sources of ``events`` that aren't
        among the routes fail too. Returns the new generation, None if no source is
        sound, and the verdicts (source_key, verdict, reason, events it has now, those added); those of a
        generation can be read again by ``verdicts``.
        """
        base_id = self.active()
        states = {k: SourceState(**vars(v)) for k, v in self.generation(base_id).sources.items()}
        asked = {r["source_key"]: r for r in routes.collect()}  # one row a changed source
        batch, written = self._write_rows(events)
        found = self._route_facts(written, [k for k, r in asked.items() if r["change"] == "append" and k in states], checks or {})
        verdicts, staged = [], []
        for key in sorted(asked.keys() | found.keys()):
            route, fact, base = asked.get(key), found.get(key), states.get(key)
            reason = fact["reason"] if fact else None
            if route is None:
                reason = "not among the routes"
            elif route["change"] == "append" and (base is None or (base.frontier, base.prefix_hash) != (route["known_frontier"], route["known_hash"])):
                reason = "frontier moved"
            if reason is not None:
                verdicts.append((key, "failed", reason, base.events if base else 0, 0))
                continue
            new = SourceState([f"{batch}/{fact['part']}"], fact["events"], fact["content_sum"]) if fact else SourceState([], 0, f"{0:064x}")
            staged += new.paths
            added = new.events
            if route["change"] == "append":
                total = (int(base.content_sum, 16) + int(new.content_sum, 16)) % (1 << 256)
                new = SourceState(base.paths + new.paths, base.events + new.events, f"{total:064x}")
            new.frontier, new.prefix_hash = route["frontier"] or 0, route["prefix_hash"] or ""
            states[key] = new
            verdicts.append((key, {"append": "appended", "replace": "replaced"}.get(route["change"], "created"), None, new.events, added))
        sound = any(v[1] != "failed" for v in verdicts)
        carried = states.keys() - {v[0] for v in verdicts}
        verdicts += [(k, "carried", None, states[k].events, 0) for k in sorted(carried)]
        made = self._commit(base_id, states, staged, notes) if sound else None
        path = f"{self.root}/verdicts/{made or 'none-' + uuid.uuid4().hex}"
        self.spark.createDataFrame(verdicts, VERDICTS).coalesce(1).write.parquet(path)
        return made, self.spark.read.schema(VERDICTS).parquet(path)

    def _route_facts(self, written: DataFrame, appended: list[str], checks: dict[str, Column]) -> dict:
        """Of each source of a batch: its part, events, content sum and the first reason against it."""
        held = written.groupBy("event_id", "source_key").agg(F.count(F.lit(1)).alias("n"))
        if appended:
            base = self.read(sources=appended).groupBy("event_id", "source_key").agg(F.count(F.lit(1)).alias("n"))
            held = held.unionByName(base.join(held.select("event_id").distinct(), "event_id", "left_semi")).groupBy("event_id", "source_key").agg(F.sum("n").alias("n"))
        twice = held.groupBy("event_id").agg(F.min("source_key").alias("owner"), F.sum("n").alias("total")).filter("total > 1")
        repeated = held.join(twice, "event_id").filter((F.col("n") > 1) | (F.col("source_key") != F.col("owner"))).groupBy("source_key").agg(F.min("event_id").alias("repeated"))
        broken = [F.max(~F.coalesce(c, F.lit(False))).alias(f"broken_{i}") for i, c in enumerate(checks.values())]
        facts = written.groupBy("source_key").agg(F.count(F.lit(1)).alias("events"), *broken)
        reason = F.coalesce(*[F.when(F.col(f"broken_{i}"), F.lit(name)) for i, name in enumerate(checks)], F.when(F.col("repeated").isNotNull(), F.concat(F.lit("repeated id "), "repeated")))
        rows = facts.join(repeated, "source_key", "left").join(content_sums(written), "source_key")
        return {r["source_key"]: r for r in rows.select("source_key", "events", "content_sum", reason.alias("reason"), F.sha2("source_key", 256).alias("part")).collect()}

    def publish(
        self,
        replace: DataFrame | None = None,
        append: DataFrame | None = None,
        delete: list[str] = (),
        absent: list[str] = (),
        frontiers: dict[str, tuple[int, str]] | None = None,
        expected: str | None = None,
        notes: dict[str, str] | None = None,
    ) -> str:
        """Publish a new generation and return its id.

        ``replace``: all rows of their sources; ``append``: further rows of
        sources with a certified frontier; ``delete``: sources that are gone for
        sure; ``absent``: sources not seen this time, deleted after
        ``GRACE_ABSENCES`` times in a row. Others are retained as they are. With
        ``expected`` the publication fails if another came in between.
        """
        base_id = self.active()
        if expected is not None and expected != base_id:
            raise RuntimeError("another generation was published in between")
        base = self.generation(base_id)
        states = {k: SourceState(**vars(v)) for k, v in base.sources.items()}
        for key in absent:
            if key in states:
                states[key].absences += 1
                if states[key].absences >= GRACE_ABSENCES:
                    del states[key]
        for key in delete:
            states.pop(key, None)
        staged: list[str] = []
        if replace is not None:
            new_states = self._stage(replace)
            states |= new_states
            staged += [p for s in new_states.values() for p in s.paths]
        grown: list[str] = []
        if append is not None:
            for key, new in self._stage(append).items():
                staged += new.paths
                if key not in states:
                    raise ValueError(f"append to a source without a frontier: {key}")
                old = states[key]
                total = (int(old.content_sum, 16) + int(new.content_sum, 16)) % (1 << 256)
                states[key] = SourceState(old.paths + new.paths, old.events + new.events, f"{total:064x}", old.frontier, old.prefix_hash)
                grown.append(key)
        for key, (end, prefix) in (frontiers or {}).items():
            if key in states:
                states[key].frontier, states[key].prefix_hash = end, prefix
        if grown:  # new rows against those that were there
            self._refuse_repeated(self._parts([(k, p) for k in grown for p in states[k].paths]))
        return self._commit(base_id, states, staged, notes)

    def duplicates(self, generation_id: str | None = None) -> DataFrame:
        """Event ids that stand in a generation more than once; an error, never repaired."""
        return self.read(generation_id).groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    def republish(self, notes: dict[str, str]) -> str:
        """A new manifest over the same data."""
        return self.publish(notes=notes)

    # -- housekeeping ------------------------------------------------------
    def lease(self, generation_id: str, holder: str) -> None:
        self._write(f"leases/{holder}.json", json.dumps({"generation": generation_id}))

    def release(self, holder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/leases/{holder}.json"), False)

    def _listed(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def reclaim(self) -> list[str]:
        """Delete generations that aren't active, previous or leased, and their data."""
        pointer = self.pointer() or {}
        kept = {pointer.get("active"), pointer.get("previous")}
        kept |= {json.loads(self._read(f"leases/{n}"))["generation"] for n in self._listed("leases") if n.endswith(".json")}
        kept -= {None}
        for name in self._listed("generations"):
            if name.endswith(".json") and name[:-5] not in kept:
                self._fs.delete(self._path(f"{self.root}/generations/{name}"), False)
        for folder in ("verdicts", "term-index", "work"):
            for name in self._listed(folder):
                path = self._path(f"{self.root}/{folder}/{name}")
                if name not in kept and time.time() * 1000 - self._fs.getFileStatus(path).getModificationTime() > CLAIM_SECONDS * 1000:
                    self._fs.delete(path, True)  # no longer being written or read by a publication
        used = {p.split("/")[1] for g in kept for s in self.generation(g).sources.values() for p in s.paths}
        gone = [d for d in self._listed("data") if d not in used]
        for d in gone:
            self._fs.delete(self._path(f"{self.root}/data/{d}"), True)
        return gone
