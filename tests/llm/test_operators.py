"""Each operator against brute force, round trips or held-out labels, and its edge cases."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from venuelens.llm import decontaminate, language, licenses, lines, nearest, packing, pii, quality, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark int, line_drop string"
#: Nulls, empty and repeated rows, a long text, names that operators use themselves.
ROWS = [
    (1, None, "en", "s", None, 1, "x"),
    (2, "", None, None, 0, 1, "x"),
    (2, "", None, None, 0, 1, "x"),
    (None, "No id here. Mail a@b.co now", "en", "s", 1, None, None),
    (4, "word " * 40_000, "en", "s", 200_000, 2, "y"),
    (5, "A b c d e f g h", "en", "s", 15, 3, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


# -- classifiers -------------------------------------------------------------------


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(1)
    good = [(i, " ".join(words(rng, 80 + i)) + ".") for i in range(60)]
    bad = [(100 + i, "!!! ".join(w.upper() for w in words(rng, 60 + i))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    marks = labels(spark, [(i, int(i < 100), 0) for i, _ in good + bad])
    model = quality.train(docs, marks, F.col("doc_id") % 2 == 0)
    scored = docs.withColumn("s", quality.quality_score(F.col("text"), model)).where("doc_id % 2 = 1").collect()
    assert all((r.s >= 0.7) == (r.doc_id < 100) for r in scored)


def test_discriminant_equals_the_normal_densities(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality.N_STATS))
    y = rng.integers(0, 2, 300)
    x[y == 1] += 0.7
    rows = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(y, x, strict=True)], "y int, x array<double>")
    model = quality.fit_discriminant(rows, pooled=0.0, ridge=0.0)
    logs = []
    for k in (0, 1):
        part = x[y == k]
        cov, diff = np.cov(part.T, bias=True), x - part.mean(axis=0)
        maha = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
        logs.append(np.log((len(part) + 1) / (len(x) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * maha)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-6)


def test_toxicity_learns_words(spark):
    rng = random.Random(2)
    rows = [(i, " ".join([*words(rng, 50), *(["idiotic", "scum"] if i % 3 == 0 else [])])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.train(docs, labels(spark, [(i, 1, int(i % 3 == 0)) for i, _ in rows]), F.col("doc_id") % 2 == 0)
    scored = docs.withColumn("s", toxicity.toxicity_score(F.col("text"), model)).where("doc_id % 2 = 1").collect()
    assert all((r.s >= 0.7) == (r.doc_id % 3 == 0) for r in scored)


def test_margin_is_the_pairwise_sum():
    rng = np.random.default_rng(3)
    model = toxicity.Machine(0.3, {}, rng.normal(size=6), rng.normal(size=(6, 4)))
    at = [0, 2, 5]
    pairs = sum(model.factors[i] @ model.factors[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert np.isclose(model.margin(at), 0.3 + model.weight[at].sum() + pairs)


def test_classifiers_without_labels_and_on_odd_rows(spark, odd):
    for marks in (labels(spark), labels(spark, [(5, 1, 0), (None, 1, 1), (4, None, None)])):
        q, t = quality.train(odd, marks), toxicity.train(odd, marks)
        out = odd.select(quality.quality_score(F.col("text"), q).alias("q"), toxicity.toxicity_score(F.col("text"), t).alias("t")).collect()
        assert len(out) == len(ROWS) and all(0 <= v <= 1 for r in out for v in r)
    assert odd.limit(0).select(quality.quality_score(F.col("text"), q)).count() == 0


def test_language_on_held_out_texts_mixtures_and_odd_rows(spark, real, odd):
    model = language.train(real, F.col("doc_id") % 2 == 0)
    held = real.where("doc_id % 2 = 1").select("lang", language.predict_language(F.col("text"), model).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in held) >= 0.95 * len(held)
    by = {r.lang: r.text for r in real.where("n_chars > 1500").select("lang", "text").collect()}
    mixed = spark.createDataFrame([(by["de"][:1500] + " " + by["fr"][:1500],)], "text string")
    shares = mixed.select(language.predict_language(F.col("text"), model).alias("p")).first().p.proportions
    assert set(shares) == {"de", "fr"} and all(0.3 < v < 0.7 for v in shares.values())
    got = odd.select("doc_id", language.predict_language(F.col("text"), model).alias("p")).collect()
    assert {r.p.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"}
    nothing = language.train(odd.limit(0))
    assert odd.select(language.predict_language(F.col("text"), nothing).alias("p")).first().p.lang_pred == "und"


# -- copies ------------------------------------------------------------------------


def brute_components(values, budget):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("chunk_rows", [simhash.CHUNK_ROWS, 3])
def test_simhash_groups_equal_brute_force(spark, chunk_rows):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(300):
        v = rng.choice(values)
        for bit in rng.sample(range(64), rng.randrange(1, 6)):
            v ^= 1 << bit
        values.append(v)
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), chunk_rows)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    want = brute_components(values, 3)
    mine = [got.get(v, v) for v in signed]
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in range(len(values)) for j in range(i))
    assert len(set(want)) < len(values)


def test_fingerprint_by_definition():
    import xxhash

    text = "Eins ZWEI\tdrei Ärger eins zwei x drei Ärger eins"
    parts = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + 3]).encode(), 42) for i in range(len(parts) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_of(text) == want
    assert simhash.fingerprint_of(None) == simhash.fingerprint_of(" \n") == 0
    assert simhash.fingerprint_of("Ab c") == xxhash.xxh64_intdigest(b"ab c", 42)


def test_first_of_each_group_stays(spark, odd):
    """Against the links between all fingerprints; a few words are changed in texts of many."""
    rng = random.Random(5)
    base = words(rng, 3000)
    edited = [list(base) for _ in range(30)]
    for copy in edited:
        copy[rng.randrange(3000)] = "changed"
    texts = [" ".join(base), " ".join(base), *map(" ".join, edited), *(" ".join(words(rng, 300)) for _ in range(20))]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, fp int")
    roots = brute_components([simhash.fingerprint_of(t) for t in texts], 3)
    assert len(set(roots)) < 40
    for rows in (simhash.CHUNK_ROWS, 4):
        kept = simhash.first_of_each_group(docs, chunk_rows=rows)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots))
    again = simhash.first_of_each_group(odd)
    assert again.columns == odd.columns and sorted(r.doc_id or 0 for r in again.collect()) == [0, 1, 4, 5]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.near_duplicates(odd).count() == len(ROWS)


def test_lines_equal_the_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cursor = con.execute(queries.ORACLES["op10_lines"])
    names = [c[0] for c in cursor.description]
    got = queries.op10_lines(spark, SF).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall())


def test_lines_of_a_long_text_are_cut_in_one_pass(spark):
    """Time follows the number of lines, whatever the number of drops."""
    import time

    shared = [f"shared line number {i:06d} that many documents hold" for i in range(16_000)]
    own = [f"own {i}" for i in range(16_000)]
    both = [x for pair in zip(shared, own, strict=True) for x in pair]
    one = [shared[0], *(f"own line {i}" for i in range(32_000))]
    docs = [(i, "\n".join(shared)) for i in range(10, 15)] + [(1, "\n".join(both)), (2, "\n".join(one))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in lines.dedup_lines(frame).collect()}
    assert time.perf_counter() - began < 30
    assert got[1].text == "\n".join(own) and got[1].n_dropped == 16_000
    assert got[2].text == "\n".join(one[1:]) and got[2].n_lines == 32_001
    assert got[14].text == "\n".join(shared) and got[10].text == ""


def test_lines_on_odd_rows(spark, odd):
    line = "This line is shared by many documents, long enough."
    shared = spark.createDataFrame([(10 + i, f"  {line.upper()}\t\nown {i}", None, None, 1, i, "q") for i in range(5)], DOCS)
    out = lines.dedup_lines(odd.union(shared))
    assert out.count() == len(ROWS) + 5 and set(odd.columns) < set(out.columns)
    texts = {r.doc_id: (r.text, r.n_dropped) for r in out.where("doc_id >= 10").collect()}
    assert texts[10] == ("own 0", 1) and texts[14][1] == 0
    assert lines.dedup_lines(odd.limit(0)).count() == 0


# -- scans -------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits or "0"),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                yield (kind, m.start(), m.end())


def test_base_spans_equal_plain_patterns(spark, real, odd):
    rng = random.Random(6)
    noise = ["".join(rng.choices("ab0129@.+-_ ()é😀\n", k=200)) for _ in range(200)]
    noise += ["x" * 50_000, "1" * 50_000, "a.b@c.d_e@f.g", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8 256.1.1.1", "é +1 (222) 333-4444"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(noise)], "doc_id bigint, text string")
    for frame in (docs, real.select("doc_id", "text"), odd.select("doc_id", "text")):
        for r in frame.select("text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect():
            assert [tuple(x) for x in r.s] == list(plain_spans(r.text))


def test_contexts_find_unseen_identifiers(spark, odd):
    rows = [(i, f"Please write to me{i}@mail.org today") for i in range(12)]
    rows += [(50 + i, f"Please write to user-{i}4711x today") for i in range(2)] + [(60, "see version 20260101 there")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(s) for s in out[50].extra] == [("identifier", 16, 27)] and not out[60].extra and len(out[3].base) == 1
    assert pii.find_personal_data(odd).count() == len(ROWS) and pii.find_personal_data(odd.limit(0)).count() == 0


def extras(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.find_personal_data(docs, **options).collect()
    texts = dict(rows)
    return {(r.doc_id, texts[r.doc_id][x.start : x.end]) for r in found for x in r.extra}


def test_finds_lead_to_contexts_without_seeds(spark):
    """Seeds share "reach me at"; the handles found there are met again after "ping", where no seed ever is."""
    rows = [(i, f"reach me at me{i}@mail.org") for i in range(9)]
    rows += [(20 + i, f"reach me at zz{i}handle") for i in range(4)] + [(30 + i, f"then ping zz{i}handle now") for i in range(4)]
    rows += [(40, "then ping qq7someone now"), (50, "room 12345678 here")]
    got = {d: v for d, v in extras(spark, rows)}
    assert all(got[20 + i] == got[30 + i] == f"zz{i}handle" for i in range(4)) and got[40] == "qq7someone" and 50 not in got
    assert 40 not in {d for d, _ in extras(spark, rows, rounds=1)}


def test_labels_of_secrets_are_seed_patterns(spark):
    secrets = ["token = \"0123abcd4567\"", "API_KEY: sk-99887766", "my password = hunter2hunter2", "\"secret\" = a1b2c3d4"]
    clean = ["version 2.0.1234 of it", "broken = 4567890123", "monkey: 12345678", "4111111111111112 x", "token = 123", "at 300.1.1.1 there"]
    rows = [(i, f"some words {x} and more") for i, x in enumerate(secrets + clean)]
    assert {d for d, _ in extras(spark, rows, rounds=1)} == set(range(len(secrets)))


def test_planted_secrets_are_found_and_nothing_else(spark):
    found, planted = set(), set()
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_personal_data(docs).collect():
        found |= {(r.doc_id, texts[r.doc_id][x.start : x.end]) for x in r.extra}
    for i, text in texts.items():
        planted |= {(i, m) for m in re.findall(r'token = "([0-9a-f]{40})"', text)}
    assert planted and found == planted


def test_places_of_matches_in_long_texts(spark):
    """Linear time, and right places across the chunks that are summed apart."""
    import time

    long = " ".join(f"é{i} me{i}@mail.org 10.0.{i % 256}.{i % 250}" for i in range(16_000))
    docs = spark.createDataFrame([(1, long)], "doc_id bigint, text string")
    began = time.perf_counter()
    found = pii.find_personal_data(docs).first()
    assert time.perf_counter() - began < 60
    assert [tuple(x) for x in found.base] == list(plain_spans(long))


def test_licenses_match_whole_units_only(spark, odd):
    mit = licenses.KNOWN[7][1]
    rows = [
        (1, "Copyright (c) 2024 Someone\n" + mit.replace("sublicense", "sub-license").upper()),
        (2, "Intro line.\nReleased under the MIT Licence\nmore"),
        (3, "Prose that says it was Released under the MIT License. and goes on"),
        (4, None),
    ]
    known = licenses.known_licenses(spark)
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), known).collect()
    assert {(r.doc_id, r.license_id, r.level, r.position) for r in got} == {(1, "MIT", "document", 0), (1, "MIT", "line", 1), (2, "MIT", "line", 1)}
    assert licenses.scan_licenses(odd, known).count() == 0 and licenses.scan_licenses(odd.limit(0), known).count() == 0
    assert all(re.search(licenses.KEYWORDS, text) for _, text in licenses.KNOWN)


def test_license_files_of_several_paragraphs(spark):
    mit, bsd = licenses.KNOWN[7][1], licenses.KNOWN[11][1]
    parts = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\r\n\r\nTHE")
    clauses = bsd.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n \n3. ").replace(" THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS")
    rows = [
        (1, "MIT License\n\nCopyright (c) 2024 Someone\n\n" + parts),
        (2, "Some prose first.\n\nThe MIT License (MIT)\n\n" + parts + "\n\nAnd after."),
        (3, "BSD 3-Clause License\r\n\r\n" + clauses),
        (4, "Intro\n\n" + clauses + "\n\nOutro"),
        (5, "Intro\n\n" + parts + " more words in the last paragraph\n\nOutro"),
        (6, "Intro\n\n" + parts.rsplit("\n", 1)[0] + "\n\nOutro"),
    ]
    known = licenses.known_licenses(spark)
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"), known).collect()
    assert sorted((r.doc_id, r.license_id, r.level, r.position) for r in got) == [
        (1, "MIT", "document", 0), (2, "MIT", "paragraphs", 2), (3, "BSD-3-Clause", "document", 0), (4, "BSD-3-Clause", "paragraphs", 1),
    ]


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(50):
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 20)
        h = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, matched, begin, end = decontaminate.align(a, b)
        assert score == h.max() and 0 <= begin < end <= 20 and matched * 2 >= score


def test_edited_copies_are_found_and_others_left(spark, odd):
    rng = random.Random(8)
    item = words(rng, 40)
    edited = [w if i % 8 else "other" for i, w in enumerate(item)]
    docs = [(1, " ".join([*words(rng, 200), *item, *words(rng, 90)])), (2, " ".join([*words(rng, 50), *edited])), (3, " ".join([*words(rng, 90), *item[:7]]))]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, ""), (9, " ".join(item)), (12, "a b c d e f g h")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame.union(odd.select("doc_id", "text")), items).collect()}
    assert set(got) == {(1, 9), (2, 9), (5, 12)} and got[1, 9].score == 1.0 and got[1, 9].n_matched == 40
    text = docs[0][1].lower()
    assert text[got[1, 9].start : got[1, 9].end] == " ".join(item)
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


def test_heavily_edited_copies_equal_alignment_of_whole_texts(spark):
    rng = random.Random(12)
    item = words(rng, 40)
    docs = [(k, " ".join([*words(rng, 50), *[w if i % k else f"x{i}" for i, w in enumerate(item)], *words(rng, 50)])) for k in (3, 4, 5, 6, 8)]
    docs += [(100 + i, docs[1][1]) for i in range(60)]
    items = spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs) and min(r.score for r in got) >= 0.5
    for _ in range(300):
        item = [f"w{rng.randrange(8)}" for _ in range(rng.randrange(10, 25))]
        text = [x for w in item for x in rng.choice([[w], [w], [w, "y"], [w, "y", "y"], ["x"], []])] + ["p", "p"]
        block = decontaminate.Items([(1, " ".join(item))])
        score = decontaminate.align(block.words[0], block.numbers(text))[0]
        assert [m[1] for m in block.matches(" ".join(text), 0.5)] == [score / (2 * len(item))] * (score >= len(item))


def test_short_items_need_more_than_a_shared_phrase(spark):
    rng = random.Random(13)
    docs, items, copies = [], [], set()
    for n in (5, 6, 7, 8, 9):
        item = words(rng, n)
        items.append((n, " ".join(item)))
        made = {0: item, 1: [*item[:2], "x", *item[3:]], 2: item[:3], 3: item[-3:]}
        docs += [(10 * n + k, " ".join([*words(rng, 30), *part, *words(rng, 30)])) for k, part in made.items()]
        copies |= {(10 * n, n), (10 * n + 1, n)}
    items = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == copies


# -- vectors, packing --------------------------------------------------------------


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    x[500:900] = x[500]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0]), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("tree", F.lit("x"))
    got = {}
    for r in nearest.search(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r)
    y = x.astype(float)
    found = 0
    assert set(got) == set(range(0, 2000, 20))
    for q, rows_of in got.items():
        rows_of.sort(key=lambda r: r["rank"])
        score = y @ y[q]
        want = sorted((i for i in range(2000) if i != q), key=lambda i: (-score[i], i))[:20]
        found += len({r.vec_id for r in rows_of} & set(want))
        assert [r["rank"] for r in rows_of] == list(range(1, 21)) and all(np.isclose(r.score, score[r.vec_id], atol=1e-12) for r in rows_of)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(rows_of, rows_of[1:], strict=False))
    assert found >= 0.9 * 20 * len(got)
    assert nearest.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_keeps_the_smaller_ids_of_many_equals(spark):
    """Vectors of zeros and ones have large groups of equal products; all leaves are visited."""
    rng = np.random.default_rng(15)
    x = rng.integers(0, 2, size=(600, 9)).astype(float)
    x[:, 0] = 1
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {}
    for r in nearest.search(frame, F.col("vec_id") % 20 == 0, trees=1, depth=2, visits=4).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in range(0, 600, 20):
        want = sorted((i for i in range(600) if i != q), key=lambda i: (-(x[i] @ x[q]), i))[:20]
        assert [found[q][k] for k in range(1, 21)] == want


def test_packing_round_trip(spark, real, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    strange = [(-1, "a  b\n\n c\t d"), (-2, " x <|endoftext|> y\n"), (-3, "a\t b"), (-4, "x\x1cy \x85 z")]
    docs = odd.select("doc_id", "text").distinct().union(real.select(F.col("doc_id") + 100, "text"))
    docs = docs.union(spark.createDataFrame(strange, "doc_id bigint, text string"))
    pieces = {}
    rows = packing.pack(docs, path).collect()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.offset == 0 for r in rows)
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 for r in rows)
    for r in docs.collect():
        want = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[r.doc_id], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == want
        assert [p.length for p in own] == packing.binary_lengths(len(want))
    assert packing.pack(odd.limit(0), path).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 0 < len(left) < 200 and len(set(left.values())) == len(left)
    assert sum(r.length for r in packing.pack(docs, queries.tokenizer_path()).collect()) > 0
