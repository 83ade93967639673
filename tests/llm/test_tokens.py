import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from byteloom.llm import lattice, packing, prefix_bpe, sentencepiece_codec, token_counts
from tests.llm.helpers import DOCS, ODD, table, words

LETTERS = "aeiot nrsl  \n\n\t'' 'restvedm'll0123,.!?-é ñß中文😀 　AZ<|>\0\x1c▁"


def samples(seed, n=250):
    rng = random.Random(seed)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.choice([0, 3, 40, 200]))) for _ in range(n)]
    return out + ["", "a" * 400, " " * 300, " " * 37 + "x", "é" * 150, "<s> <0x41> <unk> <|endoftext|>", "the " * 80, "they'll've're 's", " 's 're"]


@pytest.fixture(scope="module")
def library():
    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_prefix_has_its_count(library):
    texts = samples(1)
    c = token_counts.counter(token_counts.VOCABULARY)
    for text, got, n in zip(texts, c.prefix_counts(pa.array(texts)), c.counts(pa.array(texts))):
        expected = [len(library.encode_ordinary(text[:i])) for i in range(1, len(text) + 1)]
        assert got.tolist() == expected
        assert n == (expected[-1] if expected else 0)


def test_stored_tables_answer_without_encoding(spark, library):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 400))) for i in range(5)] + ODD
    docs = table(spark, rows).withColumn("prefix_table", F.lit(0))
    for r, (i, text) in zip(token_counts.prefix_table(docs, budgets=(0, 7, 100)).collect(), rows):
        assert r.doc_id == i
        if text is None:
            assert r.n_tokens is None and r.prefix_table is None and r.chars_7 is None
            continue
        counts = token_counts.unpack(bytes(r.prefix_table))
        assert len(counts) == len(text) and r.n_tokens == len(library.encode_ordinary(text))
        for b in (0, 7, 100):
            fits = [k + 1 for k, n in enumerate(counts.tolist()) if n <= b]
            assert r[f"chars_{b}"] == (max(fits) if fits else 0)
        if len(text) < 3000:
            for k in range(0, len(text), 97):
                assert counts[k] == len(library.encode_ordinary(text[: k + 1]))
    assert token_counts.prefix_table(spark.createDataFrame([], DOCS)).count() == 0


def test_wide_tables():
    for counts in ([1, 200, 3], [5, 70_000, 2], []):
        assert token_counts.unpack(token_counts.pack(np.array(counts, np.int64))).tolist() == counts


def test_scalar_and_lattice_agree(library):
    rng = random.Random(3)
    c = token_counts.counter(token_counts.VOCABULARY)
    pieces = [bytes(rng.choice(b"abehtrnios e\xc3\xa9") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    size = np.array([len(p) + 1 for p in pieces])
    start = np.cumsum(size) - size
    units = np.zeros(int(size.sum()), np.int64)
    for s, p in zip(start, pieces):
        units[s : s + len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + 1
    last, number = c.lattice.solve(units, start)
    ids, n = c.lattice.tokens(last, number, start + size - 1)
    at = 0
    for s, p, k in zip(start, pieces, n):
        assert number[s : s + len(p) + 1].tolist() == c.prefixes(p)
        assert ids[at : at + k].tolist() == library._encode_single_piece(p)
        at += k


def test_memory_of_pieces_is_bounded():
    r = lattice.Remembered(10, np.int32)
    for k in range(5):
        pieces = [b"%d" % i for i in range(k * 6, k * 6 + 6)]
        for _ in range(2):
            at, n = r.rows(pieces, lambda new: (new[::-1], np.repeat(new[::-1], 2) + k * 6, np.full(len(new), 2)))
        assert lattice.expand(r.flat, at, n).tolist() == np.repeat(np.arange(k * 6, k * 6 + 6), 2).tolist()
        assert len(r.slot) <= 12


def test_distinct_pieces():
    data = np.frombuffer(b"ab\0ab\0\0c\0", np.uint8)
    values, place, which = lattice.distinct(data, np.array([0, 3, 6, 7]), np.array([2, 5, 7, 8]))
    assert [values[i] for i in which] == [b"ab", b"ab", b"\0", b"c"] and len(values) == 3
    assert all(which[p] == k for k, p in enumerate(place))
    assert lattice.distinct(data, np.zeros(0, int), np.zeros(0, int))[0] == []


def thue_morse(n):
    """A word of which many hashes can't tell the complement."""
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_made_to_collide_keep_their_own_tokens(library):
    swap = str.maketrans("ab", "ba")
    for n in (1024, 2048):
        texts = [thue_morse(n), thue_morse(n).translate(swap), "x " + thue_morse(n).translate(swap)]
        c = token_counts.Counter(token_counts.VOCABULARY)
        assert c.counts(pa.array(texts)).tolist() == [len(library.encode_ordinary(t)) for t in texts]
        for text, got in zip(texts, c.prefix_counts(pa.array(texts))):
            assert got[-1] == len(library.encode_ordinary(text)) and got[n // 2] == len(library.encode_ordinary(text[: n // 2 + 1]))
        sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
        ids, sizes = sentencepiece_codec.Codec(sentencepiece_codec.MODEL).encode(pa.array(texts))
        for text, part in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
            assert part.tolist() == sp.encode(text)


def test_models_other_than_byte_pair_are_refused(tmp_path, monkeypatch):
    with open(sentencepiece_codec.MODEL, "rb") as f:
        data = f.read()
    assert sentencepiece_codec.is_bpe(data)
    unigram = bytes([2 << 3 | 2, 2, 3 << 3, 1])  # settings of a trainer whose kind of model is 1
    assert not sentencepiece_codec.is_bpe(unigram) and not sentencepiece_codec.is_bpe(b"")
    monkeypatch.setattr(sentencepiece_codec, "is_bpe", lambda _: False)
    with pytest.raises(ValueError):
        sentencepiece_codec.Codec(sentencepiece_codec.MODEL)


def test_merges_take_the_best_then_the_leftmost():
    assert prefix_bpe.merged([b"a", b"a", b"a"], {b"aa": 1}) == [b"aa", b"a"]
    assert sentencepiece_codec.merged("aaa", {"aa": -1.0}) == ["aa", "a"]
    assert sentencepiece_codec.merged("abc", {"ab": -2.0, "bc": -1.0}) == ["a", "bc"]


def test_encoding_equals_the_library_and_comes_back():
    texts = samples(4)
    c, sp = sentencepiece_codec.codec(sentencepiece_codec.MODEL), sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    ids, n = c.encode(pa.array(texts))
    data, size = c.decode(ids, n)
    a = b = 0
    for text, k, s in zip(texts, n, size):
        assert ids[a : a + k].tolist() == sp.encode(text)
        assert data[b : b + s].tobytes().decode() == sp.decode(sp.encode(text)) == text.replace("▁", " ")
        a, b = a + k, b + s


def test_codec_on_tables(spark):
    docs = table(spark, ODD).withColumn("ids", F.lit(0))
    out = sentencepiece_codec.encode(docs)
    rows = out.collect()
    assert [r.doc_id for r in rows] == [i for i, _ in ODD]
    assert all(r.exact for r, (_, t) in zip(rows, ODD) if t is not None)
    assert all(r.ids is None and r.n_tokens is None for r, (_, t) in zip(rows, ODD) if t is None)
    assert [r.text for r in sentencepiece_codec.decode(out).collect()] == [t for _, t in ODD]
    assert sentencepiece_codec.encode(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        sentencepiece_codec.decode(spark.createDataFrame([(1, [40_000])], "doc_id long, ids array<int>")).collect()


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if fit is None:
            rooms.append(capacity)
            fit = len(rooms) - 1
        rooms[fit] -= n
    return sorted(rooms)


def laid_out(slots):
    used = defaultdict(list)
    for length, _, bins, each, first, offset in slots:
        for b in range(bins):
            used[first + b] += [(offset + j * length, length) for j in range(each)]
    return used


def test_plan_is_best_fit_decreasing():
    rng = random.Random(7)
    for _ in range(200):
        capacity = rng.randint(1, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        used = laid_out(packing.plan(dict(Counter(lengths)), capacity))
        for slots in used.values():
            at = 0
            for offset, n in sorted(slots):
                assert offset == at
                at += n
            assert at <= capacity
        assert sorted(n for s in used.values() for _, n in s) == sorted(lengths)
        assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == best_fit(lengths, capacity)


def test_documents_take_the_slots(spark):
    rng = random.Random(9)
    rows = [(i % 150, i, rng.choice([1, 5, 5, 7, 30, 64, 65, 200])) for i in range(300)] + [(None, 1000, 5), (3, 1001, 0)]
    lengths = spark.createDataFrame(rows, "doc_id long, k long, n long")
    out = packing.packed(lengths, 64, salt_rows=3).collect()
    parts = [min(64, n - p) for _, _, n in rows if n for p in range(0, n, 64)]
    assert sorted(r.n_places for r in out) == sorted(parts)
    assert all(r.token_start == r.piece * 64 for r in out)
    bins = defaultdict(list)
    for r in out:
        bins[r.bin].append((r.offset, r.n_places))
    for slots in bins.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 64
    assert sorted(64 - sum(n for _, n in s) for s in bins.values()) == best_fit(parts, 64)
    assert sorted(bins) == list(range(len(bins)))


def test_packing_of_texts(spark):
    docs = table(spark, ODD).withColumn("rank", F.lit(1)).withColumn("length", F.lit(1))
    out = packing.pack_documents(docs, capacity=128).collect()
    n = {(r.doc_id, r.k): r.n_tokens for r in token_counts.token_counts(docs).collect()}
    expected = Counter()
    for i, t in ODD:
        if t:
            expected[i] += next(v for (d, _), v in n.items() if d == i and v) + 1
    got = Counter()
    for r in out:
        got[r.doc_id] += r.n_places
    assert got == expected
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0
