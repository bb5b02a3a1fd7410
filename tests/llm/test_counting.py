"""Filter audit, collocations and token counts against brute force, with their edge cases."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from .test_operators import ROWS, SF, labels, odd  # noqa: F401
from venuelens.llm import audit, collocations, queries, tokencounts

# -- filter audit ------------------------------------------------------------------


def plain_masks(rows):
    """(part, failed letters) of rows (doc_id, text, source)."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        yield source or "", failed + "E" * (doc_id is not None and doc_id > least[text]), doc_id


def plain_audit(rows, marks):
    docs, out = list(plain_masks(rows)), {}
    for part in {p for p, _, _ in docs}:
        own = [(f, d) for p, f, d in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [(f, d) for f, d in own if x in f and not before & set(f)]
                out[part, order, step] = (
                    sum(not set(f) & {*before, x} for f, _ in own), len(gone), sum(x in f and bool(before & set(f)) for f, _ in own),
                    sum(f == x for f, _ in own), sum(marks.get(d, (0, 0))[0] == 1 for _, d in gone), sum(marks.get(d, (0, 0))[1] == 1 for _, d in gone),
                )
        for x in "ABCDE":
            total = sum(out[part, o, o.index(x) + 1][1] for o in map("".join, permutations("ABCDE")))
            for o in map("".join, permutations("ABCDE")):
                out[part, o, o.index(x) + 1] += (total,)
    return out


def test_audit_equals_brute_force(spark, odd):  # noqa: F811
    copies = [(50 + i, "The SAME text # again", None, "hot", 1, 1, "x") for i in range(30)]
    extra = [(7, "é" * 99 + " A", None, "s", 1, 1, "x"), (8, " \x0b\x0c \t\r\n", None, "", 1, 1, "x"), (9, " ".join(f"w{i}" for i in range(250)), None, "s", 1, 1, "x")]
    docs = odd.union(spark.createDataFrame(copies + extra, odd.schema))
    marks = labels(spark, [(1, 1, 0), (51, 1, 1), (51, 0, 0), (52, None, 1), (None, 1, 1), (9, 0, 0)]).withColumn("source", F.lit("clash"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.filter_audit(docs, marks).collect()}
    rows = [(r[0], r[1], r[3]) for r in [*ROWS, *copies, *extra]]
    assert got == plain_audit(rows, {1: (1, 0), 51: (1, 1), 52: (0, 1), 9: (0, 0)})
    assert audit.filter_audit(docs.limit(0), marks.limit(0)).count() == 0


def test_audit_takes_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (2, "a", "p"), (3, "bb", "q")], "doc_id bigint, text string, host string")
    own = {"S": F.length("text") < 2}
    got = audit.filter_audit(docs, labels(spark), own, copies="Z", part="host").orderBy("part", "filter_order", "step").collect()
    assert [(r.part, r.filter_order, r.kept, r.removed, r.redundant, r.shapley) for r in got] == [
        ("p", "SZ", 0, 2, 0, 3), ("p", "SZ", 0, 0, 1, 1), ("p", "ZS", 1, 1, 0, 1), ("p", "ZS", 0, 1, 1, 3),
        ("q", "SZ", 1, 0, 0, 0), ("q", "SZ", 1, 0, 0, 0), ("q", "ZS", 1, 0, 0, 0), ("q", "ZS", 1, 0, 0, 0),
    ]
    for wrong in ({"Z": own["S"]}, {"''": own["S"]}, {x: own["S"] for x in "ABCDEFGHI"}):
        with pytest.raises(ValueError):
            audit.filter_audit(docs, labels(spark), wrong, copies="Z")


def test_audit_has_no_limit_on_parts(spark):
    """More rows in the recursion than Spark's own limit; the caller's setting is left as it was."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("source"))
    before = spark.conf.get("spark.sql.cteRecursionRowLimit", None)
    assert audit.filter_audit(docs, labels(spark)).count() == 4000 * 600
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) == before


# -- collocations ------------------------------------------------------------------


def plain_collocations(rows, min_count, longest, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {x: a for x, a in counts.items() if a >= min_count and len(x[1]) > 1}
    out = []
    for (lang, p), a in frequent.items():
        if any(
            m == lang and f >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (m, q), f in frequent.items()
        ):
            continue
        cuts = [(counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min((1000 * a * totals[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
        out.append((lang, " ".join(p), a, left, right, totals[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, seen = [], Counter()
    for lang, phrase, *rest in out:
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase, *rest))
    return ranked


def test_collocations_equal_brute_force(spark, odd):  # noqa: F811
    rng = np.random.default_rng(4)
    texts = []
    for i in range(120):
        words = [f"w{int(x)}" for x in rng.zipf(1.5, 60) % 40]
        ends = rng.choice([" ", "\t ", ", ", ". ", "\n", " É ", "\x1c"], 60, p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.04, 0.02])
        texts.append((["en", "de", None, "x\ny", ""][i % 5], "".join(w + e for w, e in zip(words, ends, strict=True)) + " Big APPLE pie!" * 2))
    rows = [(x[2], x[1]) for x in ROWS] + texts
    docs = odd.select("lang", "text", "mark").union(spark.createDataFrame([(*r, 1) for r in texts], "lang string, text string, mark int"))
    docs = docs.select("lang", "text", F.lit(1).alias("f"), F.lit("x").alias("phrase"), F.lit(2).alias("h"))
    want = plain_collocations(rows, 6, 5, 30)
    assert len(want) > 60
    for block in (1 << 18, 20):  # one trie, several tries
        got = collocations.collocations(docs, 6, 5, 30, block).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs, min_count=10**9).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    big = 3 * 10**9
    phrases = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f bigint")
    counts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 7)], "lang string, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n bigint")
    got = collocations._scored(phrases, counts, totals).first()
    assert got.score == 1000 * big * 10**13 // ((big + 1) * (big + 7))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), min_size=2, max_size=5), min_size=1, max_size=60), st.lists(st.integers(0, 31), max_size=80))
def test_trie_counts_equal_plain_counts(sequences, text):
    sequences = [list(x) for x in sorted({tuple(s) for s in sequences})]
    trie = collocations.DoubleArray([[1, *(x + 1 for x in s)] for s in sequences])
    assert len(set(trie.ends.tolist())) == len(sequences)
    counts = np.zeros(len(trie.check), np.int64)
    symbols = np.array([x + 1 if 0 < x <= 30 else 0 for x in text], np.int64)
    start = int(trie.base[1]) + 1
    assert trie.check[start] == 1
    collocations.state_counts(trie.base, trie.check, start, symbols, 5, counts)
    plain = [sum(text[i : i + len(s)] == s for i in range(len(text))) for s in sequences]
    assert counts[trie.ends].tolist() == plain


# -- token counts ------------------------------------------------------------------


def library_counts(name, texts):
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return path, [len(model.encode(x)) for x in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return path, [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]


STRANGE = ["a  b\n\n c\t d", " x <|endoftext|> y\n", "a<|endoftext|>b <|endoftext|>", "x\x1cy \x85 z", "one two\nthree", "Ünï 日本 😀"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, odd, tmp_path, name):  # noqa: F811
    extra = [(100 + i, x, None, None, 0, 0, "") for i, x in enumerate(STRANGE)]
    docs = odd.union(spark.createDataFrame(extra, odd.schema)).withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    rows = [(r[0], r[1] or "") for r in [*ROWS, *extra]]
    path, counts = library_counts(name, [t for _, t in rows])
    got = tokencounts.token_counts(docs, path, str(tmp_path)).collect()
    want = [(i, len(t.encode()), n) for (i, t), n in zip(rows, counts, strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencounts.token_counts(docs.limit(0), path, str(tmp_path / "empty")).count() == 0


def test_token_cache_is_read_and_extended(spark, tmp_path, monkeypatch):
    path, cache = queries.tokenizer_path(), str(tmp_path)
    one = spark.createDataFrame([(i, f"text {i % 5}") for i in range(60)], "doc_id bigint, text string")
    tokencounts.token_counts(one, path, cache)
    stored = tokencounts.stored_counts(spark, cache, path)
    assert stored.count() == 5
    # What is stored is used: counts changed there come back.
    changed = str(tmp_path / "changed")
    stored.withColumn("n_tokens", F.lit(77).cast("bigint")).write.parquet(tokencounts._folder(changed, path))
    more = one.union(spark.createDataFrame([(100, "fresh one"), (101, "fresh one"), (102, None)], one.schema))
    for bound in (tokencounts.MISSES, 0):
        monkeypatch.setattr(tokencounts, "MISSES", bound)
        got = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(more, path, changed).collect()}
        assert all(got[i] == 77 for i in range(60)) and got[100] == got[101] == 2 and got[102] == 0
        assert tokencounts.stored_counts(spark, changed, path).count() == 7
        more = more.union(spark.createDataFrame([(200, "fresh one")], one.schema))
    # Another version of the tokenizer has counts of its own.
    monkeypatch.setattr(tokencounts, "_library", lambda p: "another\n")
    assert tokencounts.stored_counts(spark, changed, path) is None
    again = tokencounts.token_counts(one, path, changed)
    assert {r.n_tokens for r in again.collect()} == {2}


def test_counts_cover_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    _, counts = library_counts("byte_bpe_50k.json", [r.text or "" for r in docs])
    want = {(r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(docs, counts, strict=True)}
    assert {tuple(r) for r in queries.op13_tokens(spark, SF).collect()} == want
