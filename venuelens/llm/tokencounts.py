"""Token counts from a cache: a text is encoded once for each version of a tokenizer.

A text is known by the SHA-256 digest of its normalised content, a tokenizer by the digest of
its file and its library's version.  The cache is a folder of parquet files, one subfolder for
each tokenizer version, with rows (digest, n_tokens).  The digests of the documents are joined to
the stored counts; each text that has none is encoded once, however many documents hold it, and
the new counts are appended.

Only digests are shuffled for the lookups.  The texts to encode are shuffled once by digest, each
task sending one row per distinct text, so a text that a third of all documents hold is one row
per task.  Where few digests miss (``MISSES``), they are broadcast and no other text moves.  The
counts a run needs are written before the last join, so that adaptive execution can split a
frequent digest there.

Two runs may append the same digest; it counts once when read.  An append is one write job, so a
run that fails adds nothing.

Edge cases: a null text counts as empty and has no tokens; repeated rows each give a row, a null
doc_id stays null; a very long text is encoded whole, in a batch of its own; other columns of
``docs`` are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from venuelens.llm.packing import _PIECE, single_spaced
from venuelens.session import broadcast_if_small, written

#: Digests that are broadcast to find the texts to encode, at most (32 bytes each).
MISSES = 200_000
_SCHEMA = "digest binary, n_tokens bigint"
_BATCH_CHARS = 1 << 21
_KNOWN = 1 << 20


def tokenizer_version(path: str) -> str:
    """Hex digest of a tokenizer's file and of the library that reads it."""
    digest = hashlib.sha256(_library(path).encode())
    with open(path, "rb") as file:
        for part in iter(lambda: file.read(1 << 20), b""):
            digest.update(part)
    return digest.hexdigest()


def _library(path: str) -> str:
    import importlib.metadata as installed

    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return f"{name} {installed.version(name)}\n"


class TokenCounter:
    """Number of tokens of whole texts as the library gives them, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.cuts_at_blanks = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self._encode = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.cuts_at_blanks = _cuts_at_blanks(path)

    def counts(self, texts: list[str]) -> list[int]:
        """Where the tokenizer always cuts before single blanks, words are encoded once and summed."""
        if not self.cuts_at_blanks:
            return self._encode(texts)
        pieces = [_PIECE.findall(x) if x and single_spaced(x) else [x] for x in texts]
        fresh = list(set().union(*pieces).difference(self.known))
        if len(self.known) + len(fresh) > _KNOWN:
            self.known.clear()
            fresh = list(set().union(*pieces))
        self.known.update(zip(fresh, self._encode(fresh), strict=True))
        out = [sum(map(self.known.__getitem__, x)) for x in pieces]
        for x in pieces:  # a whole text is no word to keep
            if len(x) == 1:
                self.known.pop(x[0], None)
        return out


def _cuts_at_blanks(path: str) -> bool:
    """Byte-level pre-tokenizing of the text as it stands; no added token that reaches over blanks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    apart = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word")) and not set(x["content"]) & set(" \n") for x in added)
    return bool(plain and apart and not spec.get("normalizer"))


def _counter(path: str) -> TokenCounter:
    """The worker process's counter, kept from task to task."""
    kept = sys.modules.setdefault("venuelens_counters", types.ModuleType("venuelens_counters")).__dict__
    if path not in kept:
        kept[path] = TokenCounter(path)
    return kept[path]


def _count_texts(tokenizer: str):
    def run(batches):
        counter = _counter(tokenizer)
        for batch in batches:
            texts = batch["text"].tolist()
            place = np.cumsum([len(x) for x in texts]) // _BATCH_CHARS
            counts: list[int] = []
            for at in np.unique(place):
                first, last = np.searchsorted(place, [at, at + 1])
                counts += counter.counts(texts[first:last])
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": np.array(counts, np.int64)})

    return run


def content(text: Column) -> Column:
    """The content that is counted: null is the empty text."""
    return F.coalesce(text, F.lit(""))


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """Rows (digest, n_tokens) of the tokenizer's version, or None where nothing is stored yet."""
    try:
        return spark.read.schema(_SCHEMA).parquet(_folder(cache, tokenizer))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _folder(cache: str, tokenizer: str) -> str:
    return f"{cache.rstrip('/')}/version={tokenizer_version(tokenizer)}"


def append_misses(
    docs: DataFrame, keyed: DataFrame, tokenizer: str, cache: str, normalise: Callable[[Column], Column] = content
) -> None:
    """Encode each distinct text of ``docs`` that the cache lacks and append its count.

    ``keyed`` holds the digests of ``docs``.
    """
    spark = docs.sparkSession
    texts = docs.select(normalise(F.col("text")).alias("text")).select(digest_of(F.col("text")).alias("digest"), "text")
    stored = stored_counts(spark, cache, tokenizer)
    if stored is None:
        misses = texts.dropDuplicates(["digest"])
    else:
        wanted = written(keyed.select("digest").distinct().join(stored, "digest", "left_anti"), "missing-digests")
        if wanted.isEmpty():
            return
        if wanted.limit(MISSES + 1).count() <= MISSES:
            misses = texts.join(broadcast_if_small(wanted, MISSES), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            misses = texts.dropDuplicates(["digest"]).join(wanted, "digest")
    counted = misses.mapInPandas(_count_texts(tokenizer), _SCHEMA)
    counted.write.mode("append").parquet(_folder(cache, tokenizer))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def token_counts(
    docs: DataFrame, tokenizer: str, cache: str, normalise: Callable[[Column], Column] = content
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs`` (doc_id, text).

    ``tokenizer``: path of the tokenizer's file on the driver and the executors (``.json`` or
    ``.model``).  ``cache``: folder that all of them reach.  ``normalise`` may only change what
    the tokenizer does not see; ``n_bytes`` is of the normalised text.
    """
    text = normalise(F.col("text"))
    keyed = docs.select(F.col("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), digest_of(text).alias("digest"))
    keyed = written(keyed, "document-digests")
    append_misses(docs, keyed, tokenizer, cache, normalise)
    stored = stored_counts(docs.sparkSession, cache, tokenizer)
    needed = stored.join(keyed.select("digest").distinct(), "digest").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(written(needed, "needed-counts"), "digest").select("doc_id", "n_bytes", "n_tokens")
