"""Embedding as an Arrow batch function over distinct texts, with a vector cache table."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.functions.grams import pieces
from anamnesis.functions.ids import text_sha256
from anamnesis.operators.sizing import attach
from anamnesis.session import cut_lineage

# Function words that carry no topic in the stand-in embedding.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it",
    "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "we", "were", "with", "you",
)

#: Text of a batch that a task turns into Python strings at a time.
PIECE_BYTES = 4 * 1024 * 1024

Encode = Callable[[list[str]], np.ndarray]


class Embedder(Protocol):
    """What `embed_column` needs of a model."""

    name: str
    dimensions: int
    max_texts: int
    max_chars: int | None

    def load(self) -> Encode:
        """Called once per task; returns texts -> (n, dimensions) matrix."""


@dataclass(frozen=True)
class HashedEmbedder:
    """Deterministic stand-in for a model.

    Every word has a fixed direction: its SHA-256 digest has 64 hex digits, and digit d of
    place i becomes component i as 2d - 15. A text is the sum of its words' directions without
    stopwords, scaled to length one. The sums are whole numbers, so every engine agrees on them.
    """

    name: str = "hashed-64"
    dimensions: int = 64
    max_texts: int = 1024
    max_chars: int | None = None

    def load(self) -> Encode:
        words_of = re.compile(r"[^\W_]+")
        stop = frozenset(STOPWORDS)
        size = self.dimensions

        def directions(words: list[str]) -> np.ndarray:
            digests = b"".join(hashlib.sha256(w.encode()).digest() for w in words)
            raw = np.frombuffer(digests, dtype=np.uint8).reshape(len(words), -1)
            digits = np.stack([raw >> 4, raw & 15], axis=2).reshape(len(words), -1)
            return 2 * digits.astype(np.int32) - 15

        def encode(texts: list[str]) -> np.ndarray:
            # Each distinct word of the batch is hashed once; a text is then a sum of rows.
            places: dict[str, int] = {}
            listed = [[places.setdefault(w, len(places)) for w in words_of.findall(text.lower()) if w not in stop]
                      for text in texts]
            table = directions(list(places)) if places else np.zeros((0, size), dtype=np.int32)
            out = np.zeros((len(texts), size))
            for i, words in enumerate(listed):
                if words:
                    out[i] = table[words].sum(axis=0)
            norms = np.sqrt(np.einsum("ij,ij->i", out, out))
            return (out / np.where(norms == 0, 1.0, norms)[:, None]).astype(np.float32)

        return encode


def sub_batches(texts: list[str], max_texts: int, max_chars: int | None) -> Iterator[list[str]]:
    """Consecutive runs within both budgets; one over-long text forms a run by itself."""
    start, used = 0, 0
    for i, text in enumerate(texts):
        full = i - start >= max_texts or (max_chars is not None and used + len(text) > max_chars)
        if i > start and full:
            yield texts[start:i]
            start, used = i, 0
        used += len(text)
    if start < len(texts):
        yield texts[start:]


def embed_column(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "vector") -> DataFrame:
    """Append `out` ARRAY<FLOAT>; the model loads once per task and sees bounded sub-batches.

    A batch is taken in pieces of bounded bytes, whatever number of long texts Spark puts into it.
    """
    dims, max_texts, max_chars = embedder.dimensions, embedder.max_texts, embedder.max_chars

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = embedder.load()
        for piece in (batch.slice(*at) for batch in batches for at in pieces(batch[text], PIECE_BYTES)):
            texts = [t if t is not None else "" for t in piece[text].to_pylist()]
            parts = []
            for part in sub_batches(texts, max_texts, max_chars):
                vectors = np.asarray(encode(part), dtype=np.float32)
                if vectors.shape != (len(part), dims):
                    raise ValueError(f"the embedder returned {vectors.shape} for {len(part)} texts")
                parts.append(vectors)
            flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, np.float32)
            offsets = pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([*piece.columns, vectors], [*piece.schema.names, out])

    fields = df.drop(out)
    return fields.mapInArrow(encode_all, f"{_ddl(fields)}, `{out}` array<float>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def usable_cache(cache: DataFrame | None, embedder: Embedder) -> DataFrame | None:
    """Cache rows of this model and dimension; vectors of another one are never mixed in."""
    if cache is None:
        return None
    return cache.where((F.col("model") == embedder.name) & (F.size("vector") == embedder.dimensions)).select(
        "text_sha256", "vector")


def cache_misses(rows: DataFrame, embedder: Embedder, cache: DataFrame | None, text: str = "text") -> DataFrame:
    """Distinct texts (text_sha256, text) without a cached vector."""
    hashed = rows.select(text_sha256(text).alias("text_sha256"), F.col(text).alias("text"))
    distinct = hashed.groupBy("text_sha256").agg(F.any_value("text").alias("text"))
    usable = usable_cache(cache, embedder)
    return distinct if usable is None else distinct.join(usable, "text_sha256", "left_anti")


def new_cache_rows(rows: DataFrame, embedder: Embedder, cache: DataFrame | None, text: str = "text") -> DataFrame:
    """(text_sha256, model, vector) to append to the cache table."""
    embedded = embed_column(cache_misses(rows, embedder, cache, text), embedder)
    return embedded.select("text_sha256", F.lit(embedder.name).alias("model"), "vector")


def embed_distinct(rows: DataFrame, embedder: Embedder, cache: DataFrame | None = None,
                   text: str = "text", out: str = "vector") -> DataFrame:
    """Embed each distinct text once, then give every row its vector; copies cost one encoding.

    The new vectors are materialised before they are joined: an encoder must not run again
    because a later step measures or retries.
    """
    fresh = cut_lineage(new_cache_rows(rows, embedder, cache, text).select("text_sha256", "vector"))
    usable = usable_cache(cache, embedder)
    return with_vectors(rows, fresh if usable is None else fresh.unionByName(usable), text, out)


def with_vectors(rows: DataFrame, vectors: DataFrame, text: str = "text", out: str = "vector") -> DataFrame:
    """Give every row the vector (text_sha256, vector) of its text."""
    keyed = rows.withColumn("text_sha256", text_sha256(text))
    return attach(keyed, vectors.withColumnRenamed("vector", out), "text_sha256").select(*rows.columns, out)


def embedding_plan(rows: DataFrame, embedder: Embedder, cache: DataFrame | None, text: str = "text") -> DataFrame:
    """One row: distinct texts, how many are cached, how many are to embed."""
    distinct = rows.select(text_sha256(text).alias("text_sha256")).distinct()
    usable = usable_cache(cache, embedder)
    if usable is None:
        marked = distinct.withColumn("hit", F.lit(None).cast("boolean"))
    else:
        marked = distinct.join(usable.select("text_sha256", F.lit(True).alias("hit")).distinct(),
                               "text_sha256", "left")
    return marked.agg(F.count(F.lit(1)).alias("distinct_texts"),
                      F.count("hit").alias("cached"),
                      (F.count(F.lit(1)) - F.count("hit")).alias("to_embed"))
