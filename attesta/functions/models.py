"""The three model calls behind one shape each: a function from columns to a column.

An embedder maps text to an array of floats of unit length, a reranker (question, text) to a double, a chat model (prompt) to text.
The implementations here are deterministic and need no network; a deployment passes its own, loaded once a worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MIN_SPAN, tokens

Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]
Chat = Callable[[Column], Column]

REFUSAL = "The provided sources do not answer this question."
GENERAL = "GENERAL"


def hashed_embedder(dim: int = 64) -> Embedder:
    """Signed hashed term counts, scaled to unit length; a text without tokens gets zeros."""

    @F.arrow_udf("array<float>")
    def embed(texts):
        import re
        import zlib

        import numpy as np
        import pyarrow as pa

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts.to_pylist()):
            for w in re.findall("[a-z0-9]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, (h >> 1) % dim] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out = (out / np.where(norm == 0, 1, norm)).astype(np.float32)
        return pa.ListArray.from_arrays(np.arange(0, dim * len(out) + 1, dim, dtype=np.int32), pa.array(out.ravel()))

    return lambda c: embed(c).alias("embedding")


def overlap_reranker(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokens(text))) / F.size(q))


def extractive_chat(first_id: Column, first_body: Column) -> Column:
    """An answer that quotes the first source's first line, with its id; the refusal if that is too short to be a quote."""
    line = F.regexp_replace(F.element_at(F.split(first_body, r"\n"), 1), '"', "'")
    return F.when(F.length(line) >= MIN_SPAN, F.concat(F.lit('The text says: "'), line, F.lit('" ['), first_id, F.lit("]"))).otherwise(F.lit(REFUSAL))
