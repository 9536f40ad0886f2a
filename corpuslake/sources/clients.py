"""Embedding and language-model clients: protocols, executor-side application, HTTP clients and deterministic stand-ins.

The HTTP clients call a model server with the JSON endpoints /api/embeddings, /api/chat and /api/generate. They hold
nothing but settings, so they go to the executors as they are. The stand-ins are for tests and for runs without a
server; they are not models.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """One with settings that change its vectors tells them in an attribute `identity`, by which vectors are kept."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    def chat(self, prompt: str) -> str: ...

    def generate(self, prompt: str) -> str: ...

    def stream(self, prompt: str) -> Iterator[str]: ...


class HashEmbedder:
    """Signed counts of hashed words, normalised."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions
        self.identity = f"hash-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


class EchoModel:
    """Answers with the first line of the question's references."""

    def chat(self, prompt: str) -> str:
        return prompt.split("\n\n")[2][:200] if prompt.count("\n\n") > 1 else prompt[:200]

    generate = chat

    def stream(self, prompt: str) -> Iterator[str]:
        for word in self.chat(prompt).split(" "):
            yield word + " "


def posted(url: str, body: dict, timeout: float) -> Iterator[dict]:
    """The JSON objects of an answer, one a line."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answered_lines:
        for line in answered_lines:
            if line.strip():
                yield json.loads(line)


def again(call: Callable, retries: int, wait: float):
    """call's result; after a lost connection or a server's error it is tried again, each time after twice the wait."""
    for left in range(retries, -1, -1):
        try:
            return call()
        except OSError as e:
            refused = isinstance(e, urllib.error.HTTPError) and e.code < 500
            if refused or not left:
                raise
            time.sleep(wait * 2 ** (retries - left))


@dataclass(frozen=True)
class HttpEmbedder:
    """Vectors from a model server: `many` texts a request to /api/embed, or one to /api/embeddings where many is 1."""

    host: str
    model: str
    timeout: float = 30.0
    many: int = 1
    retries: int = 2
    wait: float = 0.5

    @property
    def identity(self) -> str:
        return f"http-{self.model}"

    def _asked(self, texts: list[str]) -> list[list[float]]:
        if self.many == 1:
            return [next(posted(f"{self.host}/api/embeddings", {"model": self.model, "prompt": texts[0]}, self.timeout))["embedding"]]
        return next(posted(f"{self.host}/api/embed", {"model": self.model, "input": texts}, self.timeout))["embeddings"]

    def embed(self, texts: list[str]) -> list[list[float]]:
        groups = [texts[i : i + self.many] for i in range(0, len(texts), self.many)]
        return [v for g in groups for v in again(lambda g=g: self._asked(g), self.retries, self.wait)]


@dataclass(frozen=True)
class HttpModel:
    """Answers from a model server; `system`, where a prompt begins with it, goes as the system message of a chat."""

    host: str
    model: str
    temperature: float = 0.1
    system: str = ""
    timeout: float = 300.0

    def _chat(self, prompt: str, stream: bool) -> Iterator[dict]:
        user = prompt.removeprefix(self.system).lstrip("\n") if self.system else prompt
        told = [{"role": "system", "content": self.system}] if user != prompt else []
        body = {"model": self.model, "messages": [*told, {"role": "user", "content": user}], "options": {"temperature": self.temperature}, "stream": stream}
        return posted(f"{self.host}/api/chat", body, self.timeout)

    def chat(self, prompt: str) -> str:
        return next(self._chat(prompt, False))["message"]["content"].strip()

    def generate(self, prompt: str) -> str:
        body = {"model": self.model, "prompt": prompt, "options": {"temperature": self.temperature}, "stream": False}
        return next(posted(f"{self.host}/api/generate", body, self.timeout))["response"].strip()

    def stream(self, prompt: str) -> Iterator[str]:
        for piece in self._chat(prompt, True):
            if text := piece.get("message", {}).get("content", ""):
                yield text


def embedded(df: DataFrame, embedder: Embedder, text: str, column: str = "embedding") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{column: embedder.embed([t or "" for t in b[text]])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, {column} array<float>")


def identity(embedder: Embedder) -> str:
    """What an embedder's vectors are kept under: its `identity`, or the name of its class."""
    kind = type(embedder)
    return getattr(embedder, "identity", None) or f"{kind.__module__}.{kind.__qualname__}"


def tried(embedder: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each text; a request that fails is parted until the failing texts are alone."""
    if not texts:
        return []
    try:
        found = embedder.embed(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
        return [(v, None) if v is not None else (None, "no vector") for v in found]
    except Exception as e:  # noqa: BLE001  any client's failure is that of its texts
        if len(texts) == 1:
            return [(None, str(e) or type(e).__name__)]
        half = len(texts) // 2
        return tried(embedder, texts[:half]) + tried(embedder, texts[half:])


def attempted(df: DataFrame, embedder: Embedder, text: str, column: str = "embedding", many: int = 256) -> DataFrame:
    """df with a vector, or null and a message in `<column>_error`; the embedder gets up to `many` texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b[text]]
            pairs = [p for i in range(0, len(texts), many) for p in tried(embedder, texts[i : i + many])]
            yield b.assign(**{column: [v for v, _ in pairs], f"{column}_error": [e for _, e in pairs]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, {column} array<float>, {column}_error string")


def answer(model: LanguageModel, prompt: str) -> str:
    """The chat call's answer, the plain generation's if that fails."""
    try:
        return model.chat(prompt)
    except Exception:  # noqa: BLE001  any client's failure leads to the other call
        return model.generate(prompt)


def answered(df: DataFrame, model: LanguageModel, prompt: str = "prompt", column: str = "answer") -> DataFrame:
    """df with the model's answers; a failed call gives null and its message in `<column>_error`."""

    def one(p):
        if p is None:
            return None, None
        try:
            return answer(model, p), None
        except Exception as e:  # noqa: BLE001  one bad call doesn't stop the job
            return None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [one(p) for p in b[prompt]]
            yield b.assign(**{column: [a for a, _ in pairs], f"{column}_error": [e for _, e in pairs]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, {column} string, {column}_error string")


def answer_stream(model: LanguageModel, prompt: str) -> Iterator[str]:
    """Pieces of the answer; if streaming fails before the first piece, the whole answer as one."""
    begun = False
    try:
        for piece in model.stream(prompt):
            begun = True
            yield piece
    except Exception:  # noqa: BLE001
        if begun:
            raise
        yield answer(model, prompt)
