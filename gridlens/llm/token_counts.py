"""Token counts: batch encoding in Arrow functions that return lengths only.

Each text is cut at safe boundaries, the counts of the parts are added up, and
only parts that the worker has not met are encoded, in batches balanced by
bytes.  A boundary is safe in front of a single space between two characters
that aren't white space: a byte-level pre-tokenizer starts a new token there
whatever stands around it, so the parts give the tokens of the whole text.
Long texts are cut the same way, so no text is encoded in one piece unless it
has no such boundary."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import id_text
from .textvec import slices

BATCH_BYTES = 1 << 20       # text in one call of the library
MEMO_PARTS = 400_000        # part -> count entries a worker keeps
MEMO_PART_CHARS = 64        # longer parts are not kept
_UNSAFE = re.compile(r"\s\s")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=4)
def _byte_bpe(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks already use the cores
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path), {}


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def safe_parts(text: str) -> list[str]:
    """Cut ``text`` at its safe boundaries."""
    if _UNSAFE.search(text) or text[:1].isspace() or text[-1:].isspace():
        return _SAFE_CUT.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def _balanced(parts: list[str]) -> Iterator[list[str]]:
    batch, size = [], 0
    for part in parts:
        if batch and size + len(part) > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(part)
        size += len(part)
    if batch:
        yield batch


def count_byte_bpe(texts: list[str], path: str) -> list[int]:
    tokenizer, memo = _byte_bpe(path)
    if len(memo) > MEMO_PARTS:
        memo.clear()
    cut = [safe_parts(t) if t else [] for t in texts]
    unknown = list({p for parts in cut for p in parts if p not in memo})
    once = {}
    for batch in _balanced(unknown):
        for part, got in zip(batch, tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
            (memo if len(part) <= MEMO_PART_CHARS else once)[part] = len(got)
    if once:
        return [sum(once[p] if p in once else memo[p] for p in parts) for parts in cut]
    return [sum(map(memo.__getitem__, parts)) for parts in cut]


def count_pieces(texts: list[str], path: str) -> list[int]:
    """Sentence pieces join words and spaces freely, so texts are not cut here."""
    model, out = _pieces(path), []
    for batch in _balanced(texts):
        out += [len(x) for x in model.encode(batch, num_threads=1)]
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer_path`` ends in ``.json`` (byte-level BPE) or ``.model`` (sentence
    pieces).  A null text is empty and has 0 bytes and 0 tokens; a null id stays
    null; repeated rows give repeated rows; an empty table gives an empty one."""
    count = count_pieces if tokenizer_path.endswith(".model") else count_byte_bpe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            for a, b in slices(texts, BATCH_BYTES):
                part = texts.slice(a, b - a)
                tokens = np.array(count(part.to_pylist(), tokenizer_path), np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.compute.binary_length(part).cast(pa.int64()),
                    pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
