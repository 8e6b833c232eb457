"""Vectors as arrays of floats; sums are in double precision."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prepended to queries, never to documents.
QUERY_PREFIX = "Instruct: Given a question, retrieve passages that answer it\nQuery: "


class Encoder(Protocol):
    """Anything that turns texts into vectors."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


def encode_query(encoder: Encoder, text: str, prefix: str = QUERY_PREFIX) -> list[float]:
    """A query's vector; ``prefix`` is what the encoder's model wants before queries."""
    return encoder.encode([prefix + text])[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))
