"""Offline stand-ins for remote models, and the fixed steps around their calls."""

from __future__ import annotations

import hashlib
import inspect
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.batches import small_batches


class TextModel(Protocol):
    def generate(self, prompt: str, temperature: float = 0.0) -> str: ...


class Silent:
    """Answers nothing, so that every caller takes its fall-back."""

    def generate(self, prompt: str, temperature: float = 0.0) -> str:
        return ""


#: Model providers by name; a program registers its own.
PROVIDERS: dict[str, Callable[..., TextModel]] = {"silent": Silent}


def provider(name: str, model: str | None = None) -> TextModel:
    """The provider of a name, for a certain model if it takes one."""
    if (make := PROVIDERS.get(name.lower())) is None:
        raise ValueError(f"unknown provider: {name}, not one of {', '.join(PROVIDERS)}")
    takes = "model" in inspect.signature(make).parameters
    return make(model=model) if model and takes else make()


def _place(word: str) -> tuple[int, float]:
    h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")
    return h, 1.0 if h >> 63 else -1.0


def hashed_embeddings(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors of signed word hashes; each different word is hashed once."""
    split = [t.lower().split() for t in texts]
    known = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    places = [_place(w) for w in known]
    at, sign = np.array([h % dim for h, _ in places], dtype=np.int64), np.array([s for _, s in places])
    word = np.array([known[w] for words in split for w in words], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), [len(words) for words in split])
    out = np.bincount(row * dim + at[word], sign[word], len(texts) * dim).reshape(-1, dim) if len(word) else np.zeros((len(texts), dim))
    return out / np.where((norm := np.linalg.norm(out, axis=1, keepdims=True)) > 0, norm, 1.0)


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    return hashed_embeddings([text], dim)[0].tolist()


def in_batches(texts: list[str], call: Callable[[list[str]], list[list[float]]], size: int = 100, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Embeddings of a remote model, some texts a call; a call that fails is tried again after 1, 2, ... seconds."""
    out: list[list[float]] = []
    for i in range(0, len(texts), size):
        for n in range(tries):
            try:
                out += call(texts[i : i + size])
                break
            except Exception:  # noqa: BLE001  whatever the provider raises
                if n + 1 == tries:
                    raise
                wait(2.0**n)
    return out


def embed(df: DataFrame, text_col: str, dim: int = 64, call: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Adds ``embedding`` in Arrow batches: by hashed words, or by a remote model's call."""

    small_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            own = batch.fillna("").tolist()
            yield pd.Series(in_batches(own, call) if call else list(hashed_embeddings(own, dim)))

    return df.withColumn("embedding", run(F.col(text_col)))


def rewritten(question: str, model: TextModel) -> str:
    """The model's rewrite, or the question itself if there is none."""
    try:
        return model.generate(f"Rewrite for search: {question}").strip() or question
    except Exception:  # noqa: BLE001  whatever the provider raises
        return question


def expanded(question: str, model: TextModel) -> list[str]:
    """Up to three phrasings from a JSON list of two or more, or the question itself."""
    try:
        found = json.loads(model.generate(f"Three phrasings as a JSON list: {question}"))
        return [str(x) for x in found[:3]] if isinstance(found, list) and len(found) >= 2 else [question]
    except Exception:  # noqa: BLE001
        return [question]


def extracted(docs: DataFrame, model: TextModel, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, raw, error): one model call a document, errors apart; texts under 50 characters are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in batch.itertuples(index=False):
                try:
                    if len(t or "") < 50:
                        raise ValueError("text is too short")
                    rows.append((k, json.dumps(json.loads(model.generate(t))), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["key", "raw", "error"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_col).mapInPandas(run, f"key {kind}, raw string, error string").withColumnRenamed("key", key)


def extraction_counts(found: DataFrame) -> DataFrame:
    """One row: documents processed and failed."""
    return found.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
