"""Token counts by a public byte-level BPE."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Where the vocabulary of ranks lies on the driver, a parameter of every function that counts tokens; executors without it get it from the driver.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODINGS: dict = {}


def encoding(path: str = VOCABULARY):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of ``docs`` (doc_id bigint, source, text); null ids and null or empty texts are left out."""

    def scan(rows):
        encode = encoding(path).encode_ordinary
        for batch in rows:
            sizes = [len(encode(text)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    docs.sparkSession.sparkContext.addFile(path)
    return docs.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "source", "text").mapInArrow(scan, "doc_id long, source string, n_tokens long")
