"""Identity rules. Prefixes, separators and digest lengths are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash


def _text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def content_id(prefix: str, col: Column) -> Column:
    """doc-, chunk-, ent-, parent- and rel- ids: prefix plus MD5 of the text."""
    return F.concat(F.lit(prefix), F.md5(col))


def relation_key(src: Column, tgt: Column) -> Column:
    return content_id("rel-", F.concat(src, tgt))


def scoped_chunk_id(doc: Column, index: Column) -> Column:
    return F.concat(doc.cast("string"), F.format_string("-c%04d", index))


def _norm(col: Column) -> Column:
    return F.lower(squash(_text(col)))


def _digest(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 24)


def scoped_entity_id(kb: Column, kind: Column, name: Column, model: Column | None = None) -> Column:
    extra = F.lit("") if model is None else _norm(model)
    return F.concat(F.lit("ent-"), _digest(F.trim(_text(kb)), _norm(kind), _norm(name), extra))


def scoped_relation_id(kb: Column, src: Column, kind: Column, tgt: Column) -> Column:
    parts = (F.trim(_text(kb)), F.trim(_text(src)), _norm(kind), F.trim(_text(tgt)))
    return F.concat(F.lit("rel-"), _digest(*parts))


def content_hash(col: Column) -> Column:
    return F.sha2(_text(col), 256)


def version_id(col: Column) -> Column:
    return F.substring(content_hash(col), 1, 16)


def stable_chunk_id(document: Column, anchor: Column, body: Column) -> Column:
    """Identity that survives insertions before the chunk when it has no structural place."""
    place = F.when(anchor.startswith("index:"), F.lit("content")).otherwise(anchor)
    return F.concat(F.lit("schunk-"), _digest(_text(document), place, squash(_text(body))))


def request_hash(*args: Column) -> Column:
    return F.md5(F.concat(*[_text(a) for a in args]))


def evidence_id(document: Column, version: Column, chunk: Column, unit: Column) -> Column:
    raw = F.concat_ws("\n", _text(document), _text(version), _text(chunk), _text(unit))
    return F.concat(F.lit("ev-"), F.substring(F.sha2(raw, 256), 1, 16))
