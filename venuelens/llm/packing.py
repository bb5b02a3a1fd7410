"""Packing by powers of two: a document is cut into pieces of binary length.

The tokens of a document, with one closing id, are cut into full sequences of ``max_length``
and then into pieces whose lengths are the binary digits of the rest, longest first.
Each piece is a sequence of its own, so no sequence crosses documents and none is padded.
Pieces of equal length form a bucket; sequence ids of a bucket are next to each other, so a
batch of consecutive ids has one length.

Token ids are those of the tokenizer's own encoding of the whole text.  A text is cut before
blanks and line feeds that stand alone between other characters; there the tokenizer's
pre-tokenizer always cuts as well, so the ids of a word are found once and reused.  Any other
text is encoded as one.

Edge cases: a null text counts as empty, an empty text has the closing id alone; lone
surrogates can't occur in Spark strings; repeated rows are packed one by one; sequence ids
are unique within one run and depend on how the input is dealt out.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 2048
CLOSING_ID = 1

_PIECE = re.compile(r" ?[^ \n]+|\n")
_KNOWN = 1 << 20
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def single_spaced(text: str) -> bool:
    """Whether all white space is blanks and line feeds that stand alone between other characters."""
    if any(two in text for two in ("  ", "\n\n", " \n", "\n ")) or text[0] in " \n" or text[-1] in " \n":
        return False
    return sum(map(len, text.split())) + text.count(" ") + text.count("\n") == len(text)


class _Known(dict):
    """Words to ids; words of the texts at hand are found in ``fresh`` where there was no more room."""

    fresh: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.fresh[word]


class Encoder:
    """Whole texts to their ids, as little-endian unsigned 32-bit numbers; words are encoded once."""

    def __init__(self, path: str, most: int = _KNOWN):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known()
        self.most = most

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in found]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a text that is not single-spaced is one piece."""
        pieces = [_PIECE.findall(x) if x and single_spaced(x) else [x] for x in texts]
        fresh = list(set().union(*pieces).difference(self.known))
        self.known.fresh = dict(zip(fresh, self._encode(fresh), strict=True))
        if len(self.known) < self.most:
            self.known.update(self.known.fresh)
        return [b"".join(map(self.known.__getitem__, x)) for x in pieces]


def _encoder(path: str, most: int) -> Encoder:
    """The worker process's encoder, kept from task to task; files of one path are not told apart."""
    kept = sys.modules.setdefault("venuelens_encoders", types.ModuleType("venuelens_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path, most)
    return kept[path]


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Full lengths, then the binary digits of the rest, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, closing_id: int = CLOSING_ID, known_words: int = _KNOWN
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens,
    sequence_id, offset (always 0: a piece fills its sequence).

    ``tokenizer``: path of the tokenizer's file on the executors.  ``max_length`` must be a
    power of two.  ``known_words``: words whose ids a worker keeps, at most (about 200 bytes each).  A sequence id has the length's place in its top bits (longer first), then
    the task, then a number in the task.
    """
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    closing = np.array([closing_id], "<u4").tobytes()
    levels = max_length.bit_length()

    def cut(batches):
        encoder = _encoder(tokenizer, known_words)
        task = TaskContext.get().partitionId()
        used = [0] * levels
        for doc_ids, texts in _parts(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(doc_ids, encoder.ids(texts), strict=True):
                ids += closing
                n, start = len(ids) // 4, 0
                for length in binary_lengths(n, max_length):
                    level = levels - length.bit_length()
                    sequence = level << 57 | task << 32 | used[level]
                    used[level] += 1
                    row = (doc_id, start, length, ids[4 * start : 4 * (start + length)], n, sequence)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += length
            yield _batch(out)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(cut, _SCHEMA)


def _parts(batches) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of some rows at a time, of some million characters."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size > 1 << 21:
                yield ids, texts
                ids, texts, size = [], [], 0
        yield ids, texts


def _batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    arrays = [pa.array(v, k) for v, k in zip(out, kinds, strict=True)]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.zeros(len(out[0]), np.int64))], names)
