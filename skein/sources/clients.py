"""Language-model clients: injected, and asked from Spark tasks; failures come back as data.

A client is any picklable object with ``chat(system, user, json) -> str`` that raises on failure. The HTTP
clients below speak two common local-server protocols.
"""

from __future__ import annotations

import json as jsonlib
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.batches import slices

ROWS = 256  # whose answers stand in memory together


class ChatClient(Protocol):
    def chat(self, system: str, user: str, json: bool = False) -> str: ...


class EmbeddingClient(Protocol):
    def embed(self, text: str) -> list[float]: ...


@dataclass
class Generation:
    """What a model wrote, with the tokens and seconds that it reports (0 if it reports none)."""

    text: str
    tokens: int = 0
    seconds: float = 0.0


class GenerateClient(Protocol):
    def generate(self, prompt: str) -> Generation: ...


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, jsonlib.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return jsonlib.load(answer)


@dataclass
class NativeChat:
    """Chat over ``/api/chat``."""

    host: str
    model: str
    timeout: float = 120
    temperature: float = 0.0

    def chat(self, system: str, user: str, json: bool = False) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "stream": False, "messages": messages, "options": {"temperature": self.temperature}}
        got = _post(f"{self.host}/api/chat", body | ({"format": "json"} if json else {}), self.timeout)
        text = (got.get("message") or {}).get("content") or ""
        if not text:
            raise RuntimeError("the model gave no content")
        return text


@dataclass
class CompatibleChat:
    """Chat over ``/v1/chat/completions``."""

    host: str
    model: str
    timeout: float = 120
    temperature: float = 0.0

    def chat(self, system: str, user: str, json: bool = False) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        body = {"model": self.model, "messages": messages, "temperature": self.temperature}
        got = _post(f"{self.host}/v1/chat/completions", body | ({"response_format": {"type": "json_object"}} if json else {}), self.timeout)
        text = ((got.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        if not text:
            raise RuntimeError("the model gave no content")
        return text


@dataclass
class NativeEmbed:
    """Embeddings over ``/api/embeddings``."""

    host: str
    model: str
    timeout: float = 2.5

    def embed(self, text: str) -> list[float]:
        got = _post(f"{self.host}/api/embeddings", {"model": self.model, "prompt": text}, self.timeout).get("embedding")
        if not isinstance(got, list) or not got:
            raise RuntimeError("the model gave no vector")
        return got


@dataclass
class NativeGenerate:
    """Text over ``/api/generate``; tokens and time are the model's own count and evaluation time."""

    host: str
    model: str
    timeout: float = 60
    most_tokens: int = 96

    def generate(self, prompt: str) -> Generation:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"num_predict": self.most_tokens}}
        got = _post(f"{self.host}/api/generate", body, self.timeout)
        return Generation(got.get("response") or "", got.get("eval_count") or 0, (got.get("eval_duration") or 0) / 1e9)


@dataclass
class CompatibleGenerate:
    """Text over ``/v1/chat/completions``; tokens as reported, time by the clock."""

    host: str
    model: str
    timeout: float = 60
    most_tokens: int = 96

    def generate(self, prompt: str) -> Generation:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.most_tokens, "stream": False}
        began = time.monotonic()
        got = _post(f"{self.host}/v1/chat/completions", body, self.timeout)
        seconds = time.monotonic() - began
        text = ((got.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        return Generation(text, (got.get("usage") or {}).get("completion_tokens") or 0, seconds)


@dataclass
class CannedEmbed:
    """Vectors from a function of the text; for tests and replays."""

    answer: Callable[[str], list[float]]

    def embed(self, text: str) -> list[float]:
        return self.answer(text)


@dataclass
class CannedGenerate:
    """Generations from a function of the prompt; for tests and replays."""

    answer: Callable[[str], Generation]

    def generate(self, prompt: str) -> Generation:
        return self.answer(prompt)


@dataclass
class CannedChat:
    """Answers from a function of (system, user); for tests and replays."""

    answer: Callable[[str, str], str]

    def chat(self, system: str, user: str, json: bool = False) -> str:
        return self.answer(system, user)


def ask(rows: DataFrame, client: ChatClient, system: str, user: str, answer: str = "answer", json: bool = False, parallel: int | None = None) -> DataFrame:
    """``rows`` with ``answer``, ``error`` and ``latency_ms``: one call a row, for the text in column ``user``.

    ``parallel`` sets how many tasks, and so calls, run at a time. A call that fails gives a null answer and its message.
    """

    from pyspark.sql import types as T

    names = rows.columns
    added = [T.StructField(answer, T.StringType()), T.StructField("error", T.StringType()), T.StructField("latency_ms", T.DoubleType())]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in slices(batches, ROWS):
            got, failed, took = [], [], []
            # Only the texts asked become Python objects; the other columns pass as they came.
            for text in part.column(names.index(user)).to_pylist():
                began = time.monotonic()
                try:
                    got.append(client.chat(system, "" if text is None else text, json))
                    failed.append(None)
                except Exception as e:  # whatever a client raises is the row's error
                    got.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
                took.append((time.monotonic() - began) * 1000)
            made = [pa.array(got, pa.string()), pa.array(failed, pa.string()), pa.array(took, pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*names, *(f.name for f in added)])

    dealt = rows.repartition(parallel) if parallel else rows
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def _generation(client: GenerateClient | ChatClient, prompt: str) -> tuple[Generation | None, str | None, float]:
    """(what it wrote, its error, milliseconds); a chat client's tokens are words and its time is the clock's."""
    began = time.monotonic()
    try:
        if hasattr(client, "generate"):
            made = client.generate(prompt)
        else:
            text = client.chat("", prompt)
            made = Generation(text, len(text.split()), time.monotonic() - began)
        return made, None, (time.monotonic() - began) * 1000
    except Exception as e:  # whatever a client raises is the row's error
        return None, f"{type(e).__name__}: {e}", (time.monotonic() - began) * 1000


def generate_with(rows: DataFrame, clients: dict[str, GenerateClient | ChatClient], prompt: str = "prompt", parallel: int | None = None) -> DataFrame:
    """``rows`` with <name>_text, _tokens, _seconds, _latency_ms and _error for each client; a row's clients are asked at once."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import types as T

    kinds = {"text": T.StringType(), "tokens": T.LongType(), "seconds": T.DoubleType(), "latency_ms": T.DoubleType(), "error": T.StringType()}
    added = [T.StructField(f"{name}_{c}", k) for name in clients for c, k in kinds.items()]
    names = [f.name for f in added]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(len(clients)) as pool:
            for pdf in batches:
                made: dict[str, list] = {n: [] for n in names}
                for text in pdf[prompt]:
                    jobs = {name: pool.submit(_generation, c, "" if text is None else text) for name, c in clients.items()}
                    for name, job in jobs.items():
                        got, error, took = job.result()
                        values = (got.text, got.tokens, got.seconds, took, None) if got else (None, 0, 0.0, took, error)
                        for column, value in zip(kinds, values):
                            made[f"{name}_{column}"].append(value)
                yield pdf.assign(**made)

    dealt = rows.repartition(parallel) if parallel else rows
    return dealt.mapInPandas(run, T.StructType([*rows.schema.fields, *added]))


HYDE_PROMPT = "Answer the question in one short passage of two to four sentences, in the plain style of a reference text. Give the passage only."


def hypothetical_documents(prompts: DataFrame, client: ChatClient) -> DataFrame:
    """query_id, prompt, search_text, hyde_error: the passage to search with, or the prompt itself where none was made."""
    asked = ask(prompts.select("query_id", "prompt"), client, HYDE_PROMPT, "prompt", "passage")
    passage = F.when(F.trim("passage") != "", F.trim("passage"))
    error = F.coalesce("error", F.when(passage.isNull(), "empty passage"))
    return asked.select("query_id", "prompt", F.coalesce(passage, "prompt").alias("search_text"), error.alias("hyde_error"))


RERANK_PROMPT = 'Rate how relevant the passage is to the question from 0 to 10. Answer with JSON only: {"score": number}.'


def rerank_calls(candidates: DataFrame, prompts: DataFrame, client: ChatClient) -> DataFrame:
    """``candidates`` with llm_score (null where the call or its answer failed) and rerank_error."""
    from skein.operators.fusion import rerank_score

    both = candidates.join(prompts.select("query_id", "prompt"), "query_id")
    asked = ask(both.withColumn("_user", F.concat(F.lit("Question: "), "prompt", F.lit("\nPassage: "), "text")), client, RERANK_PROMPT, "_user", "_raw", json=True)
    scored = asked.withColumn("llm_score", rerank_score(F.col("_raw")))
    failed = F.when(F.col("llm_score").isNull(), F.coalesce("error", F.lit("no score in the answer")))
    return scored.withColumn("rerank_error", failed).drop("_user", "_raw", "error", "prompt")
