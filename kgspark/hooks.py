"""Places to plug in chunkers, embedders, scorers, reducers and token counters.

A hook is a column function or a DataFrame function; models run as batch UDFs inside it. The
defaults need no model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark.functions.text import token_count, tokens
from kgspark.operators import chunking, graph_build, vectors


def token_overlap(query: Column, text: Column) -> Column:
    """Default relevance: share of the query's distinct tokens that the text contains."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


CHUNKERS: dict[str, Callable[..., Column]] = {
    "fixed": chunking.fixed_windows,
    "legacy": chunking.legacy_windows,
    "retrieval": chunking.retrieval_windows,
    "table_guarded": chunking.table_guarded_split,
    "smart": chunking.smart_split,
    "sticky_tables": chunking.sticky_tables,
    "qa": chunking.qa_pieces,
}
EMBEDDERS: dict[str, Callable] = {"hashed": vectors.hashed_embedding}
SCORERS: dict[str, Callable[[Column, Column], Column]] = {"token_overlap": token_overlap}
REDUCERS: dict[str, Callable[[list[str]], str]] = {"concatenate": graph_build.concatenate}
TOKEN_COUNTERS: dict[str, Callable[[Column], Column]] = {"mixed": token_count}


def _register(table: dict, name: str, fn) -> None:
    if name in table:
        raise ValueError(f"{name} is registered already")
    table[name] = fn


def register_chunker(name: str, fn: Callable[..., Column]) -> None:
    """``fn(text column, …)`` returns ARRAY<STRING>; a pandas UDF is fine."""
    _register(CHUNKERS, name, fn)


def register_embedder(name: str, fn: Callable) -> None:
    """``fn(DataFrame, id column)`` returns a DataFrame with the vectors."""
    _register(EMBEDDERS, name, fn)


def register_scorer(name: str, fn: Callable[[Column, Column], Column]) -> None:
    """``fn(query text, document text)`` returns a relevance in [0, 1]."""
    _register(SCORERS, name, fn)


def register_reducer(name: str, fn: Callable[[list[str]], str]) -> None:
    """``fn(list of texts)`` returns one text; it sees a bounded group."""
    _register(REDUCERS, name, fn)


def register_token_counter(name: str, fn: Callable[[Column], Column]) -> None:
    _register(TOKEN_COUNTERS, name, fn)
