"""A ledger of model calls: equal requests are one call, and a finished call is never made again.

A ledger is a folder. ``answers/`` is a Parquet table (key, payload, error, latency_ms, asked_at), the key a hash of
the kind of call, model, system and user text. ``journal/`` holds what running jobs have been told so far: a task appends each answer
there before it asks for the next, so a task that is lost and run again reads its own answers back, and what a
failed job leaves behind is moved into the table by the next one. The folder is a path with a scheme, or one that every
machine mounts.

A call that fails is written, too, but is asked again the next time: only answers are final.
"""

from __future__ import annotations

import json as jsonlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.clients import ChatClient, EmbeddingClient, GenerateClient, _generation
from skein.sources.tables import settled

ANSWERS = "key string, payload string, error string, latency_ms double, asked_at double"
#: Calls that one task makes at most on average, and so answers that it reads back after a loss.
TASK_CALLS = 20_000
#: Requests that more than one row in HOT asks are at most HOT in number; their answers are broadcast.
HOT = 200


def request_key(kind: str, model: str, system: Column, user: Column) -> Column:
    """Hash of a request; lengths stand before the texts, so no two requests run together."""
    parts = [F.lit(kind), F.lit(model), F.coalesce(system, F.lit("")), F.coalesce(user, F.lit(""))]
    return F.sha2(F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))), 256)


class Journal:
    """What one task of a job has been told, by key; kept in files of whole lines under a folder of its own."""

    def __init__(self, folder: str, every: int):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.every, self.unsaved = every, []
        self.fs.create_dir(self.folder, recursive=True)
        self.told: dict[str, dict] = {}
        for info in self.fs.get_file_info(fs.FileSelector(self.folder)):
            if info.path.endswith(".json"):
                with self.fs.open_input_stream(info.path) as f:
                    rows = map(jsonlib.loads, f.read().decode().splitlines())
                    self.told.update((r["key"], r) for r in rows if r["error"] is None)

    def add(self, row: dict) -> None:
        self.unsaved.append(row)
        if len(self.unsaved) >= self.every:
            self.save()

    def save(self) -> None:
        """The file has its name only once it is whole."""
        if self.unsaved:
            name = f"{self.folder}/{uuid.uuid4().hex}"
            with self.fs.open_output_stream(name + ".part") as f:
                f.write("".join(jsonlib.dumps(r) + "\n" for r in self.unsaved).encode())
            self.fs.move(name + ".part", name + ".json")
            self.unsaved = []


class Ledger:
    """The calls of a folder. ``every`` answers are written together (1: none is ever asked for twice after a loss)."""

    def __init__(self, spark: SparkSession, folder: str, every: int = 1):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every

    def _listed(self, name: str) -> list[fs.FileInfo]:
        at, path = fs.FileSystem.from_uri(f"{self.folder}/{name}")
        return at.get_file_info(fs.FileSelector(path, allow_not_found=True))

    def rows(self) -> DataFrame:
        """Every call that has been written, failed ones included."""
        if not any(i.path.endswith(".parquet") for i in self._listed("answers")):
            return self.spark.createDataFrame([], ANSWERS)
        return self.spark.read.schema(ANSWERS).parquet(f"{self.folder}/answers")

    def latest(self, keys: DataFrame) -> DataFrame:
        """One row for each of ``keys(key)`` that was asked: its answer if it has one, else its last failure."""
        rank = F.struct(F.col("error").isNull(), F.col("asked_at"))
        kept = F.max_by(F.struct("payload", "error", "latency_ms"), rank)
        return self.rows().join(keys, "key", "left_semi").groupBy("key").agg(kept.alias("_a")).select("key", "_a.*")

    def recover(self) -> None:
        """Answers that lost jobs left in the journal go to the table; no other job may be asking meanwhile."""
        runs = [i.path for i in self._listed("journal") if i.type == fs.FileType.Directory]
        if runs:
            left = self.spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.folder}/journal")
            done = self.rows().where("error is null").select("key")
            left.where("error is null").dropDuplicates(["key"]).join(done, "key", "left_anti").write.mode("append").parquet(f"{self.folder}/answers")
            at, _ = fs.FileSystem.from_uri(self.folder)
            for path in runs:
                at.delete_dir(path)

    def ask(self, wanted: DataFrame, call: Callable[[str, str], str], parallel: int | None = None) -> int:
        """Make the calls of ``wanted(key, system, user)``, one row a key, that have no answer yet; how many there were."""
        self.recover()
        done = self.rows().where("error is null").select("key")
        pending = settled(wanted.join(done, "key", "left_anti"), "pending")
        n = pending.count()
        if not n:
            return 0
        run, every = f"{self.folder}/journal/{uuid.uuid4().hex}", self.every

        def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # The same keys meet under the same number whenever this task runs.
            journal = Journal(f"{run}/{TaskContext.get().partitionId()}", every)
            for pdf in batches:
                rows = []
                for key, system, user in pdf[["key", "system", "user"]].itertuples(index=False, name=None):
                    row = journal.told.get(key)
                    if row is None:
                        began, payload, error = time.time(), None, None
                        try:
                            payload = call(system, user)
                        except Exception as e:  # whatever a client raises is the request's error
                            error = f"{type(e).__name__}: {e}"
                        row = {"key": key, "payload": payload, "error": error, "latency_ms": (time.time() - began) * 1000, "asked_at": began}
                        journal.add(row)
                    rows.append(row)
                yield pd.DataFrame(rows, columns=["key", "payload", "error", "latency_ms", "asked_at"])
            journal.save()

        tasks = max(parallel or self.spark.sparkContext.defaultParallelism, -(-n // TASK_CALLS))
        pending.repartition(tasks, "key").mapInPandas(told, ANSWERS).write.mode("append").parquet(f"{self.folder}/answers")
        at, path = fs.FileSystem.from_uri(run)
        at.delete_dir(path)
        return n


def _through(rows: DataFrame, ledger: Ledger, kind: str, model: str, system: Column, user: Column, call: Callable[[str, str], str], parallel: int | None) -> DataFrame:
    """``rows`` with payload, error, latency_ms of their requests, each distinct one asked at most once."""
    text = lambda c: F.coalesce(c, F.lit(""))
    keyed = rows.withColumn("_key", request_key(kind, model, system, user))
    counted = settled(keyed.groupBy("_key").agg(F.first(text(system)).alias("system"), F.first(text(user)).alias("user"), F.count("*").alias("n")), "requests")
    ledger.ask(counted.select(F.col("_key").alias("key"), "system", "user"), call, parallel)
    total = counted.agg(F.sum("n")).first()[0] or 0
    told = ledger.latest(counted.select(F.col("_key").alias("key"))).withColumnRenamed("key", "_key").join(counted.select("_key", "n"), "_key")
    told = settled(told.select("_key", F.struct("payload", "error", "latency_ms").alias("_a"), (F.col("n") * HOT > total).alias("hot")), "told")
    hot = F.broadcast(told.where("hot").select("_key", F.col("_a").alias("_h")))  # fewer than HOT rows
    # Rows that have their answer already are dealt evenly in the second join; no key is left that many rows share.
    dealt = F.when(F.col("_h").isNull(), F.col("_key")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id() % 4096))
    cold = told.where("not hot").select(F.col("_key").alias("_cold"), F.col("_a").alias("_c"))
    both = keyed.join(hot, "_key", "left").withColumn("_cold", dealt).join(cold, "_cold", "left").withColumn("_a", F.coalesce("_h", "_c"))
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), "_a.payload", "_a.error", "_a.latency_ms")


def ask_once(rows: DataFrame, ledger: Ledger, client: ChatClient, system: str, user: str, answer: str = "answer", json: bool = False, model: str | None = None, parallel: int | None = None) -> DataFrame:
    """As ``clients.ask`` (``answer``, ``error``, ``latency_ms`` for the text in column ``user``), through a ledger.

    ``model`` names the model in the key; it is the client's own by default. A null text is asked as an empty one. Calls are made when
    this is called, not when the rows are read.
    """
    name = model if model is not None else getattr(client, "model", "")
    made = _through(rows, ledger, "json" if json else "chat", name, F.lit(system), F.col(user), lambda s, u: client.chat(s, u, json), parallel)
    return made.withColumnRenamed("payload", answer)


def generate_once(rows: DataFrame, ledger: Ledger, client: GenerateClient | ChatClient, prompt: str = "prompt", name: str = "made", model: str | None = None, parallel: int | None = None) -> DataFrame:
    """``rows`` with <name>_text, _tokens, _seconds, _latency_ms and _error, through a ledger."""

    def call(system: str, user: str) -> str:
        got, error, _ = _generation(client, user)
        if got is None:
            raise RuntimeError(error)
        return jsonlib.dumps([got.text, got.tokens, got.seconds])

    made = _through(rows, ledger, "generate", model if model is not None else getattr(client, "model", ""), F.lit(""), F.col(prompt), call, parallel)
    part = lambda i, kind: F.get_json_object("payload", f"$[{i}]").cast(kind)
    added = {"text": part(0, "string"), "tokens": F.coalesce(part(1, "long"), F.lit(0)), "seconds": F.coalesce(part(2, "double"), F.lit(0.0)), "latency_ms": F.col("latency_ms"), "error": F.col("error")}
    return made.select(*(F.col(f"`{c}`") for c in rows.columns), *(v.alias(f"{name}_{k}") for k, v in added.items()))


def embed_once(rows: DataFrame, ledger: Ledger, client: EmbeddingClient, text: str = "text", out: str = "vector", model: str | None = None, parallel: int | None = None) -> DataFrame:
    """``rows`` with ``out`` (array of doubles) and ``error``, through a ledger."""
    made = _through(rows, ledger, "embed", model if model is not None else getattr(client, "model", ""), F.lit(""), F.col(text), lambda s, u: jsonlib.dumps(list(map(float, client.embed(u)))), parallel)
    return made.withColumn(out, F.from_json("payload", "array<double>")).drop("payload", "latency_ms")
