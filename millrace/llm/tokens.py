"""Token counts by a public tokenizer; its files are read from a folder that every executor has."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@cache
def encoder(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """Encoding of a vocabulary of byte ranks, with the split pattern published beside it."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, tokens, *keep) of docs (id, text, *keep); a null text has 0 tokens."""
    kept = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(folder, name).encode_ordinary
        for b in batches:
            n = [0 if t is None else len(count(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *b.columns[2:]], names=["id", "tokens", *keep])

    schema = "id long, tokens long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.select("id", "text", *keep).mapInArrow(run, schema)
