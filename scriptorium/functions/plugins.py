"""Extension points: tokenizers, embedders and text generators.

Each is a small protocol with a deterministic default, so that every plan runs
without models.  Quality figures from the defaults say nothing about models.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol
from urllib import request

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The public defaults of the model server.
OLLAMA_HOST, OLLAMA_MODEL = "http://localhost:11434", "llama3.1:8b"

#: Names the provider to use where none is given.
PROVIDER_VARIABLE = "SCRIPTORIUM_TEXT_PROVIDER"


#: Characters of texts that Python works on at once.
TOGETHER = 1 << 20


class Tokenizer(Protocol):
    def __call__(self, text: str) -> Sequence[tuple[int, int]]:
        """Character offsets (start, end) of the tokens, in order."""


class Embedder(Protocol):
    def encode(self, texts: Sequence[str], batch_size: int = 16) -> np.ndarray:
        """A float32 matrix with one row of unit length for each text."""


class Generator(Protocol):
    # Fixed interface: names and defaults of the arguments.
    def generate(self, system: str, user: str, *, max_tokens: int = 1024, temperature: float = 0.7, response_format: str | None = None, num_ctx: int | None = None) -> str: ...


def word_offsets(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


class HashedEmbedder:
    """Bag of hashed words with unit length; zero vectors stay zero."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def encode(self, texts: Sequence[str], batch_size: int = 16) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                row[int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % self.dims] += 1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(lengths == 0, 1, lengths)


class ExtractiveGenerator:
    """Answers with the first passage of the prompt; deterministic."""

    def generate(self, system: str, user: str, *, max_tokens: int = 1024, **_) -> str:
        passage = re.search(r"^\[1\] (.*)$", user, re.M)
        return " ".join((passage[1] if passage else "").split()[:max_tokens])


class OllamaGenerator:
    """A local model server, asked over its chat interface.

    Such a server answers one request at a time: ``coalesce`` the prompts first.
    """

    def __init__(self, model: str = OLLAMA_MODEL, host: str | None = None, timeout: float = 600.0):
        self.model, self.timeout = model, timeout
        self.host = (host or os.environ.get("OLLAMA_HOST") or OLLAMA_HOST).rstrip("/")
        if "://" not in self.host:
            self.host = f"http://{self.host}"

    def generate(self, system: str, user: str, *, max_tokens: int = 1024, temperature: float = 0.7, response_format: str | None = None, num_ctx: int | None = None) -> str:
        options = {"num_predict": max_tokens, "temperature": temperature} | ({} if num_ctx is None else {"num_ctx": num_ctx})
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "stream": False, "options": options}
        if response_format == "json":
            body["format"] = "json"
        asked = request.Request(f"{self.host}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with request.urlopen(asked, timeout=self.timeout) as answer:
            return json.loads(answer.read())["message"]["content"]


_providers: dict[str, Callable[[], Generator]] = {"extractive": ExtractiveGenerator, "ollama": OllamaGenerator}


def register_provider(name: str, build: Callable[[], Generator]) -> None:
    _providers[name.strip().lower()] = build


def provider_name(name: str | None = None) -> str:
    """The argument, else the environment variable, else ``ollama`` (a fixed order)."""
    chosen = (name or os.environ.get(PROVIDER_VARIABLE) or "ollama").strip().lower()
    if chosen not in _providers:
        raise ValueError(f"unknown provider {chosen!r}; known are {', '.join(sorted(_providers))}")
    return chosen


def get_provider(name: str | None = None) -> Generator:
    return _providers[provider_name(name)]()


def embed(build: Callable[[], Embedder], batch_size: int = 16) -> Callable[[Column], Column]:
    """An iterator UDF: the model is built once for each worker task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for texts in batches:
            yield pd.Series(list(model.encode(texts.fillna("").tolist(), batch_size=batch_size)))

    return run


def in_parts(texts: list[str | None], most: int = TOGETHER) -> Iterator[list[str]]:
    """The texts in their order, some at a time: about ``most`` characters, one text at least; null ones are empty.

    A batch of Spark's holds thousands of texts, and what Python makes of each is many times its size.
    """
    some: list[str] = []
    size = 0
    for text in texts:
        some.append(text or "")
        size += len(some[-1])
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def offsets(tokenizer: Tokenizer = word_offsets) -> Callable[[Column], Column]:
    """Token offsets as ``array<struct<s:int,e:int>>`` for any tokenizer."""

    @F.arrow_udf("array<struct<s:int,e:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in in_parts(texts.to_pylist()):
                ends, flat = [0], array("i")
                for text in some:
                    for span in tokenizer(text):
                        flat.extend(span)
                    ends.append(len(flat) // 2)
                pairs = np.frombuffer(flat, np.int32).reshape(-1, 2)
                spans = pa.StructArray.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["s", "e"])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)

    return run
