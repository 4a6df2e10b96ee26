"""p8: encoding of whole corpora with a public tokenizer.

The rank file is read on the executors from a path that is a parameter; it is never copied
into the repository. Long texts are pre-split where the tokenizer's own pattern always
ends a piece (before white space, and where letters, numbers and signs meet), so the pieces can
be encoded one by one and give the very ids of the whole text.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.session import batch_rows, spread, table

TOKENIZERS = os.environ.get("LOOMTEXT_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A text is encoded in chunks of about so many characters.
CHUNK = 1 << 16

#: Places where the pattern always ends a piece: before white space, and between letters, numbers and signs (but not
#: after an apostrophe, which may begin a contraction).
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


@functools.lru_cache(maxsize=4)
def encoder(name: str, folder: str = TOKENIZERS):
    """A tiktoken encoding of a local rank file, one per worker process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _bytes_of(name: str, folder: str) -> list[bytes]:
    e = encoder(name, folder)
    return [e.decode_single_token_bytes(i) for i in range(e.max_token_value + 1)]


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of a long text, cut at the first safe boundary from each size on. A stretch
    of letters alone, numbers alone or signs alone stays whole: cutting it could change the merges."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encode(text: str | None, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, size: int = CHUNK) -> list[int]:
    """Ids without special tokens; [] for a null or empty text."""
    if not text:
        return []
    e = encoder(name, folder)
    if len(text) <= size:
        return e.encode_ordinary(text)
    return [i for c in chunks(text, size) for i in e.encode_ordinary(c)]


def decode(ids: list[int] | None, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """Raw bytes of ids: exact for any cut of the id list, also inside a character."""
    b = _bytes_of(name, folder)
    return b"".join(b[i] for i in ids or ())


def with_ids(df: DataFrame, text: str, keys: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keys and ids array<int>. One row per input row; null and empty texts give []."""
    src = df.select(*keys, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", ids array<int>"

    def run(batches):
        for b in batches:
            ids = [encode(t, name, folder) for t in b.column("__text").to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
            cols = [b.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(ends, flat)], names=[*keys, "ids"])

    return src.mapInArrow(run, schema)


def with_counts(df: DataFrame, text: str | list[str], keys: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keys and n_tokens long: like with_ids, without keeping the ids. Of several texts a column for each, n_tokens_0
    and so on, in one pass."""
    texts = [text] if isinstance(text, str) else text
    names = ["n_tokens"] if isinstance(text, str) else [f"n_tokens_{i}" for i in range(len(texts))]
    src = df.select(*keys, *[F.col(t).alias(f"__text{i}") for i, t in enumerate(texts)])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), *(f"{n} long" for n in names)])

    def run(batches):
        for b in batches:
            n = [pa.array([len(encode(t, name, folder)) for t in b.column(f"__text{i}").to_pylist()], pa.int64()) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *n], names=[*keys, *names])

    return src.mapInArrow(run, schema)


def decoded(df: DataFrame, keys: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keys and content binary of an ids column; null ids give empty bytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", content binary"

    def run(batches):
        for b in batches:
            out = [decode(x, name, folder) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.binary())], names=[*keys, "content"])

    return df.select(*keys, "ids").mapInArrow(run, schema)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    batch_rows(spark, 2000)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return with_ids(docs, "text", ["doc_id"])


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters per source."""
    batch_rows(spark, 2000)
    docs = spread(table(spark, sf_dir, "documents").select("source", F.length("text").alias("chars"), "text"))
    n = with_counts(docs, "text", ["source", "chars"])
    return n.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars")
    )
