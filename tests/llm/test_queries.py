"""The registered queries against brute force over the whole small tables."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from .test_operators import PLAIN, SF, brute_components, plain_spans
from venuelens.llm import queries, simhash


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def docs():
    return {r["doc_id"]: r for r in rows_of("documents")}


@pytest.mark.parametrize(("name", "label", "parts", "rest"), [("op1_quality", "quality", 4, 2), ("op2_toxicity", "toxic", 3, 1)])
def test_scores_cover_all_documents(spark, docs, name, label, parts, rest):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for doc_id, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % parts == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_personal_data_digests(spark, docs):
    got = queries.op4_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = list(plain_spans(docs[r.doc_id]["text"]))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in want) for k in PLAIN]


def test_fingerprints_and_components(spark, docs):
    got = {r.doc_id: r for r in queries.op5_simhash(spark, SF).collect()}
    ids = sorted(docs)
    values = [simhash.fingerprint_of(docs[i]["text"]) for i in ids]
    roots = brute_components(values, 3)
    assert got.keys() == docs.keys()
    for i, v, root in zip(ids, values, roots, strict=True):
        assert got[i].fingerprint == f"{v:016x}" and got[i].component_id == ids[root]


def test_nearest_recall(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows_of("embeddings")}
    found, asked = {}, [i for i in vectors if i % 20 == 0]
    for r in queries.op7_nearest(spark, SF).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
        assert np.isclose(r.score, vectors[r.query_id] @ vectors[r.vec_id], atol=1e-12)
    hits = 0
    for q in asked:
        want = sorted((i for i in vectors if i != q), key=lambda i: (-(vectors[i] @ vectors[q]), i))[:20]
        assert sorted(found[q]) == list(range(1, 21))
        hits += len(set(want) & set(found[q].values()))
    assert hits >= 0.9 * 20 * len(asked)


def test_packed_pieces(spark, docs):
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(queries.tokenizer_path()), {}
    for r in queries.op8_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == docs.keys()
    for doc_id, own in pieces.items():
        ids = np.array([*tokenizer.encode(docs[doc_id]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda p: p.start):
            assert (r.start, r.doc_tokens, r.offset) == (at, len(ids), 0)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_planted_items_are_reported(spark, docs):
    """Every item whose words stand in a document in one run is reported with score 1."""
    words = {i: " ".join(re.findall(r"\w+", (r["text"] or "").lower())) for i, r in docs.items()}
    want = set()
    for item in rows_of("benchmark"):
        own = " ".join(re.findall(r"\w+", (item["text"] or "").lower()))
        want |= {(i, item["item_id"]) for i, text in words.items() if len(own.split()) >= 5 and f" {own} " in f" {text} "}
    got = {(r.doc_id, r.item_id): r.score for r in queries.op9_decontaminate(spark, SF).collect()}
    assert want <= got.keys() and all(got[x] == 1.0 for x in want)
