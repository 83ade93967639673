import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from byteloom.llm import buckets, common, simhash, suffix_dedup
from tests.llm.helpers import DOCS, ODD, table, words


def near_copy(rng, w, n):
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = "".join(rng.choice("abcdefgh") for _ in range(6))
    return w


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = [words(rng, rng.randint(80, 300)) for _ in range(60)]
    for k in range(12):
        texts.append(list(texts[k]))
        texts += [near_copy(rng, texts[k], len(texts[k]) // 30) for _ in range(3)]
    shared = words(rng, 60)
    for _ in range(8):
        w = words(rng, 150)
        w[70:70] = shared
        texts.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def brute_classes(rows, limit=simhash.MAX_DISTANCE):
    """Class and links of each row of distinct ids, over all pairs of distinct signatures."""
    sigs = simhash.signatures_of(pa.array([None if t is None else t.lower() for _, t in rows]))
    first = {}
    for i, s in enumerate(sigs):
        if s is not None:
            first.setdefault(s, i)
    at = list(first.values())
    bits = np.array([np.frombuffer(sigs[i], np.uint64) for i in at])
    d = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2) <= limit
    root = list(range(len(at)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(d, 1))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    node = {s: k for k, s in enumerate(first)}
    return {rows[i][0]: (rows[i][0], 0) if s is None else (rows[at[find(node[s])]][0], int(d[node[s]].sum()) - 1) for i, s in enumerate(sigs)}


def brute_groups(rows, limit=simhash.MAX_DISTANCE):
    return {i: c for i, (c, _) in brute_classes(rows, limit).items() if c != i}


def found_classes(spark, rows, **options):
    out = simhash.near_duplicates(table(spark, rows), **options).collect()
    assert len(out) == len(rows)
    return {r.doc_id: (r.class_id, r.links) for r in out}


def check_classes(found, expected, recall=0.97):
    assert found.keys() == expected.keys()
    grouped = {i for i, (c, n) in expected.items() if c != i or n}
    assert sum(found[i][0] == expected[i][0] for i in grouped) >= recall * len(grouped)
    assert sum(n for _, n in found.values()) >= recall * sum(n for _, n in expected.values())
    # Nothing is made up.
    assert all(found[i][1] <= n for i, (_, n) in expected.items()) and all(found[i] == expected[i] for i in expected.keys() - grouped)


def test_classes_and_links_match_brute_force(spark, corpus):
    expected = brute_classes(corpus)
    assert len(brute_groups(corpus)) >= 48 and sum(n for _, n in expected.values()) > 100
    check_classes(found_classes(spark, corpus), expected)


def test_oversized_buckets_lose_nothing(spark, corpus):
    rng = random.Random(8)
    big = corpus + [(1000 + i, " ".join(near_copy(rng, corpus[0][1].split(), 3))) for i in range(300)]
    check_classes(found_classes(spark, big, cap=20), brute_classes(big))
    # Blocks and whole buckets find the same.
    assert found_classes(spark, big, cap=20) == found_classes(spark, big)


def near_pairs(key, sig, limit=simhash.MAX_DISTANCE):
    def near(a, b):
        return np.bitwise_count(sig[a] ^ sig[b]).sum(axis=1) <= limit

    def block_near(s, t, end):
        return np.bitwise_count(sig[s:t, None] ^ sig[None, s:end]).sum(axis=2) <= limit

    zero = np.zeros(len(key), np.int64)
    return [p for a, b in buckets.pairs_of(key, zero, zero + 1, near, block_near) for p in zip(a.tolist(), b.tolist())]


def test_pairs_of_small_and_large_buckets():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (6, 256), dtype=np.uint8)
    bits = np.repeat(base, 100, axis=0) ^ (rng.random((600, 256)) < 0.05).astype(np.uint8)
    sig = np.packbits(bits, axis=1).view(np.uint64)
    for key in (np.zeros(600, np.int64), np.repeat(np.arange(6), 100), np.repeat(np.arange(30), 20)):
        found = near_pairs(key, sig)
        d = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2)
        expected = set(zip(*(x.tolist() for x in np.nonzero(np.triu((d <= simhash.MAX_DISTANCE) & (key[:, None] == key[None]), 1)))))
        assert len(found) == len(expected) and set(found) == expected


def test_plan_grows_with_the_number_of_signatures():
    bits, tables = zip(*(simhash.plan(10**k) for k in range(3, 11)))
    assert list(bits) == sorted(bits) and list(tables) == sorted(tables)
    for b, t in zip(bits, tables):
        assert 1 - (1 - (1 - simhash.MAX_DISTANCE / 256) ** b) ** t >= simhash.RECALL


def pairs_at(rng, distances):
    """Packed signatures, a pair for each distance: rows 2 i and 2 i + 1."""
    bits = np.repeat(rng.integers(0, 2, (len(distances), 256), dtype=np.uint8), 2, axis=0)
    for i, d in enumerate(distances):
        bits[2 * i + 1, rng.choice(256, d, replace=False)] ^= 1
    return np.packbits(bits, axis=1)


def test_recall_of_the_plan_for_15_million_over_all_distances():
    rng = np.random.default_rng(2)
    bits, tables = simhash.plan(15_000_000)
    for d in (9, 18, 27, 36, 45, 50, simhash.MAX_DISTANCE):
        b = np.unpackbits(pairs_at(rng, [d] * 2000), axis=1)
        met = np.zeros(2000, bool)
        for t in range(tables):
            key = simhash._keys(b, simhash._sample(bits, t))
            met |= key[::2] == key[1::2]
        assert met.mean() >= 0.955, d  # 0.97 less four standard errors


def test_isolated_pairs_in_an_oversized_bucket_are_found(spark):
    sig = pairs_at(np.random.default_rng(3), [20, 36, 45, simhash.MAX_DISTANCE] * 75)
    rows = spark.createDataFrame([(7, k, x.tobytes()) for k, x in enumerate(sig)], "key long, k long, sig binary")
    parts = buckets.capped(rows, cap=50)
    assert max(r["count"] for r in parts.groupBy("key", "block").count().collect()) < 100
    found = simhash.linked(parts, 8, 1).collect()
    assert {tuple(sorted((r.u, r.v))) for r in found if r.v is not None} == {(2 * i, 2 * i + 1) for i in range(300)}
    n = Counter()
    for r in found:
        n[r.u] += r.n or 0
    assert n == Counter({k: 1 for k in range(600)})  # each pair counts once, in one block or in two


def test_chains_in_large_buckets_stay_together():
    rng = np.random.default_rng(5)
    links, ways = 7, 60
    bits = np.repeat(rng.integers(0, 2, (ways, 256), dtype=np.uint8), links, axis=0)
    for i in range(ways):
        flips = rng.permutation(256)
        for j in range(links):  # neighbours are 30 bits apart, others 60 and more
            bits[links * i + j, flips[: 30 * j]] ^= 1
    order = rng.permutation(len(bits))
    sig = np.packbits(bits[order], axis=1).view(np.uint64)
    pairs = near_pairs(np.zeros(len(sig), np.int64), sig)
    d = np.bitwise_count(sig[:, None] ^ sig[None]).sum(axis=2)
    assert all(a < b and d[a, b] <= simhash.MAX_DISTANCE for a, b in pairs)
    root = list(range(len(sig)))
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(int(order[i]) // links)
    assert len(groups) == ways and all(len(g) == 1 for g in groups.values())


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.k: r.root for r in buckets.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert buckets.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_dedup_keeps_columns_and_odd_rows(spark, corpus):
    rows = corpus[:5] + [(50, corpus[0][1]), (50, corpus[0][1])] + ODD
    docs = table(spark, rows).withColumn("row_key", F.lit(1)).withColumn("k", F.lit("x")).withColumn("sig", F.lit(2))
    out = simhash.dedup_documents(docs)
    assert out.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    assert (50, corpus[0][1]) not in left and left[(0, corpus[0][1])] == 1
    assert left[(904, "one")] == 1  # rows that agree are one document
    assert left[(901, None)] == 1 and left[(902, "")] == 1 and left[(905, "!!! ??? ...")] == 1 and left[(None, None)] == 1
    assert simhash.dedup_documents(spark.createDataFrame([], DOCS)).count() == 0


def brute_spans(rows, m=suffix_dedup.MIN_WORDS):
    seen, count = {}, Counter()
    split = [(i, (t or "").split()) for i, t in sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    for i, w in split:
        for a in range(len(w) - m + 1):
            p = tuple(w[a : a + m])
            count[p] += 1
            seen.setdefault(p, (i, a))
    out = {}
    for i, w in split:
        for a in range(len(w) - m + 1):
            p = tuple(w[a : a + m])
            if count[p] > 1:
                j, b = seen[p]
                out.setdefault((i, (j, b) != (i, a)), set()).update(range(max(a, b + m) if j == i and b != a else a, a + m))
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault((r.doc_id, r.removed), set()).update(range(r.start_word, r.end_word))
    return out


def test_repeated_spans_match_brute_force(spark, corpus):
    rng = random.Random(3)
    inside = words(rng, 55)
    rows = corpus + [(500, " ".join(inside + words(rng, 20) + inside)), (501, "na " * 300), (502, " ".join(words(rng, 49)))]
    assert covered(suffix_dedup.repeated_spans(table(spark, rows)).collect()) == brute_spans(rows)


@pytest.mark.parametrize("order", ["ascending", "descending", "mixed"])
def test_shared_passages_over_many_batches_match_brute_force(spark, order):
    rng = random.Random(8)
    shared = [words(rng, 60), words(rng, 75)]
    rows = [(i, " ".join(words(rng, 12) + shared[i % 2] * (i % 3 == 0) + words(rng, 12) + shared[0] * (i % 7 == 0))) for i in range(90)]
    rows += [(None, " ".join(shared[1])), rows[3], rows[3], (200, rows[6][1]), (201, " ".join(shared[1] + shared[1]))]
    if order == "descending":
        rows.reverse()
    elif order == "mixed":
        rng.shuffle(rows)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        found = suffix_dedup.repeated_spans(table(spark, rows).coalesce(1)).collect()
    finally:
        spark.conf.set(name, before)
    assert covered(found) == brute_spans(rows)


def test_a_task_sends_few_rows_of_a_passage_that_all_documents_share(spark):
    rng = random.Random(9)
    shared = " ".join(words(rng, 50))
    docs = spark.createDataFrame([(i, f"{shared} {' '.join(words(rng, 5))}") for i in range(400)], "k long, text string").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        keys = Counter(r.key for r in suffix_dedup.retained(docs).where("place < 80").collect())
        assert max(keys.values()) <= 2
        joined = docs.withColumn("doc_id", F.col("k")).withColumn("places", F.sequence(F.lit(0), F.lit(200)))
        sent = suffix_dedup.extended(joined, "doc_id", "k", "text", "places", "bigint").select(F.explode("hs").alias("h")).where("h is not null")
        assert max(r["count"] for r in sent.groupBy("h").count().collect()) <= 2
    finally:
        spark.conf.set(name, before)


def test_minimisers_are_the_leftmost_least():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, w = int(rng.integers(41, 300)), int(rng.integers(1, 41))
        v = rng.integers(0, 9, n).astype(np.uint64)
        assert suffix_dedup._least(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(n - w + 1)]


def test_removal_keeps_the_first_occurrence(spark):
    rng = random.Random(5)
    shared, a, b = (" ".join(words(rng, n)) for n in (70, 30, 30))
    rows = [(1, f"{a}\n{shared} {b}"), (2, f"{b} {shared}\n{a}"), (3, shared), (4, shared), (4, shared), *ODD]
    docs = table(spark, rows).withColumn("places", F.lit(0)).withColumn("cuts", F.lit(0)).withColumn("row_key", F.lit(""))
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    left = {(r.doc_id, r.text): r.n_chars for r in out.collect()}
    assert (1, f"{a}\n{shared} {b}") in left
    assert left[(2, f"{b} {a}")] == len(f"{b} {a}")
    assert not any(i in (3, 4) for i, _ in left)
    assert {t for i, t in ODD if i != 908} <= {t for _, t in left}
    # "word word ..." repeats itself: its first 50 words stay.
    assert next(t for i, t in left if i == 908).split() == ["word"] * 50
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_that_agree_do_not_repeat_each_other(spark):
    text = " ".join(words(random.Random(1), 80))
    assert suffix_dedup.repeated_spans(table(spark, [(1, text), (1, text)])).count() == 0
    assert suffix_dedup.remove_repeats(table(spark, [(1, text), (1, text)])).count() == 2


def test_cut_words():
    assert suffix_dedup.without_words(" a bb\n\nccc  d ", [(1, 3)]) == " a d "
    assert suffix_dedup.without_words("é x", [(0, 1)]) == "x"
    assert suffix_dedup.without_words("a b", [(0, 2)]) == ""


def test_flat_and_pieces_hold_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a", None, "", "bé", "c" * 100])], ["t"])
    data, rows = common.flat(b.column(0))
    assert [data[a:z].tobytes().decode() for a, z in rows.T] == ["a", "", "", "bé", "c" * 100]
    assert sum(p.num_rows for p in common.pieces([b, b.slice(2)], 0, 3)) == 8
