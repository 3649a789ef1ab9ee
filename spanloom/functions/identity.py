"""Content addresses: hashes of configurations, manifests, golden sets and runs, and row ids as columns.

Identity of a few driver-side objects uses blake2b, which Spark has not; ids of rows are SHA-256 prefixes of the same
canonical JSON, so they are made where the rows are.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash(value: Any, size: int = 8) -> str:
    return hashlib.blake2b(canonical_json(value).encode(), digest_size=size).hexdigest()


def sha256_identity(value: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def run_fingerprint(config_hash: str, golden_set_hash: str, corpus_manifest_hash: str, code_version: str) -> str:
    return content_hash({"config_hash": config_hash, "golden_set_hash": golden_set_hash, "corpus_manifest_hash": corpus_manifest_hash, "code_version": code_version}, 16)


def _quoted(text: Column) -> Column:
    """A JSON string of a column."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def row_id(size: int = 16, **fields: Column | str) -> Column:
    """SHA-256 prefix of the canonical JSON of fields: text columns and literals quoted, other columns as numbers."""
    parts: list[Column] = [F.lit("{")]
    for i, name in enumerate(sorted(fields)):
        value = fields[name]
        parts.append(F.lit(("," if i else "") + f'"{name}":'))
        parts.append(F.lit(canonical_json(value)) if isinstance(value, str) else value)
    return F.substring(F.sha2(F.concat(*parts, F.lit("}")), 256), 1, size)


def text_json(column: Column) -> Column:
    return _quoted(column)


def passage_key(text: Column) -> Column:
    """Identity of a passage's text in a rerank store."""
    return row_id(32, text_sha256=F.concat(F.lit('"'), F.sha2(text, 256), F.lit('"')))


def query_key(query: Column, model_id: str, revision: str) -> Column:
    return row_id(32, model_id=model_id, query_sha256=F.concat(F.lit('"'), F.sha2(query, 256), F.lit('"')), revision=revision)


def embedding_key(text: Column, model_id: str, revision: str, normalize: bool = True) -> Column:
    return row_id(16, model_id=model_id, revision=revision, normalize=F.lit("true" if normalize else "false"), text_sha256=F.concat(F.lit('"'), F.sha2(text, 256), F.lit('"')))
