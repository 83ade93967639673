import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from byteloom import layout, sources
from byteloom.config import Segmentation, TrainerConfig
from byteloom.model import Model, info, load, merge_overlap, token_lengths, vocab_stats
from byteloom.operators import codec, kernel, segment
from byteloom.plans import catalog, chunked, train


def cut(spark, data, mode, p=1.0, seed=0):
    rows = segment.segments(sources.in_memory(spark, [data]), Segmentation(mode, p, seed)).orderBy("pos").collect()
    return [bytes(r.seg) for r in rows]


def test_segments(spark):
    assert cut(spark, b"foo  bar\tbaz", "ascii") == [b"foo", b"  ", b"bar", b"\t", b"baz"]
    assert cut(spark, "hi  there you".encode(), "unicode") == ["hi".encode(), "  ".encode(), b"there", " ".encode(), b"you"]
    assert cut(spark, b"\0alpha\0\0beta", "null") == [b"\0", b"alpha", b"\0\0", b"beta"]
    assert cut(spark, b"foo bar", "ascii", 0.0) == [b"foo bar"] and cut(spark, b"foo bar", "none") == [b"foo bar"]
    assert cut(spark, b"alpha beta gamma", "ascii", 1e-9) == [b"alpha beta gamma"]
    assert cut(spark, b" a b ", "ascii", 1e-9) == [b" ", b"a b", b" "]
    assert cut(spark, bytes(range(256)), "unicode")[0] == bytes(range(9))


def test_glue_is_seeded_and_complete(spark):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab \n\0") for _ in range(60)) for _ in range(30)]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i long, content binary")
    for mode in ("ascii", "null"):
        config = Segmentation(mode, 0.5, 3)
        rows = segment.segments(df, config, sequence="i").collect()
        again = segment.segments(df.repartition(7), config, sequence="i").collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
        for i, t in enumerate(texts):
            own = [bytes(r.seg) for r in sorted((r for r in rows if r.seq == i), key=lambda r: r.pos)]
            assert b"".join(own) == t
            if mode == "ascii":
                assert all(not s.strip(b" \n") or s == s.strip(b" \n") for s in own)


def toy(config=None):
    return TrainerConfig(vocab_size=270, min_frequency=2, reasoning=False).with_(**(config or {}))


@pytest.mark.parametrize("engine", ["memory", "spark"])
def test_worked_example(spark, engine):
    df = sources.in_memory(spark, [bytes.fromhex(x) for x in ("102010201020", "10203040", "10201020")])
    model = train.train(df, toy(), engine=engine)
    assert model.merges == [(39, 23), (23, 263)] and model.stop_reason == kernel.NO_PAIRS
    assert model.tokens[263:] == [b"\x20\x10", b"\x10\x20\x10", b"  ", b"\t\t", b"\n\n", b"\r\r", b"   "]


def test_padding_without_merges(spark):
    model = train.train(sources.in_memory(spark, [b"ab"]), toy({"vocab_size": 267, "max_iterations": 0}))
    assert model.tokens[-4:] == [b"  ", b"\t\t", b"\n\n", b"\r\r"] and model.stop_reason == kernel.ITERATIONS


def test_whitespace_rules(spark):
    for text, rule, bad in ((b"123 456 ", "require_letter", lambda t: b" " in t and t.strip() and not any(chr(c).isalpha() for c in t)), (b" foo", "forbid_leading_space", lambda t: t[:1] == b" " and t.strip())):
        model = train.train(sources.in_memory(spark, [text * 64]), toy({"vocab_size": 280, rule: True}))
        assert not any(bad(t) for t in model.tokens[263:])
    model = train.train(sources.in_memory(spark, [b"alpha beta gamma " * 64]), toy())
    assert not any(t.strip() and t[-1:] == b" " for t in model.tokens[263:])
    glyphs = train.train(sources.in_memory(spark, ["●".encode() * 64]), TrainerConfig(vocab_size=400, min_frequency=1))
    assert len(set(glyphs.tokens)) == len(glyphs.tokens) == 400


def slow(words, config):
    """Recounts all pairs for every merge."""
    decider, gone = kernel.Decider(config), set()
    rows = [([layout.FIRST_BYTE + ord(c) for c in w], n) for w, n in words]
    while not decider.full():
        counts = {}
        for w, n in rows:
            for p in zip(w, w[1:]):
                counts[p] = counts.get(p, 0) + n
        best = min(((-n, p) for p, n in counts.items() if n >= config.min_frequency and p not in gone and decider.fits(p)), default=None)
        if best is None:
            break
        verdict = decider.judge(best[1], -best[0])
        if verdict == "stop":
            break
        if verdict == "reject":
            gone.add(best[1])
            continue
        token, applied = len(decider.out.tokens), 0
        for k, (w, n) in enumerate(rows):
            new, i = [], 0
            while i < len(w):
                hit = tuple(w[i : i + 2]) == best[1]
                new.append(token if hit else w[i])
                i += 2 if hit else 1
            applied += n * (len(w) - len(new))
            rows[k] = (new, n)
        decider.merge(best[1], -best[0], applied, None)
    return decider.out


def random_words(rng):
    return [("".join(rng.choice("ab c\n") for _ in range(rng.randint(1, 12))), rng.randint(1, 4)) for _ in range(rng.randint(1, 30))]


def test_memory_engine_equals_recounting():
    rng = random.Random(2)
    for k in range(150):
        config = toy({"vocab_size": 263 + rng.randint(1, 25), "min_frequency": rng.randint(1, 3), "allowed_lengths": rng.choice([None, (1, 2, 4), (1, 2, 3)]), "require_letter": rng.random() < 0.3, "forbid_leading_space": rng.random() < 0.3, "plateau": rng.random() < 0.3, "plateau_floor": 3, "plateau_patience": 2})
        words = random_words(rng)
        a, b = kernel.train_words(words, config), slow(words, config)
        assert a.merges == b.merges and [m["merges_applied"] for m in a.metrics] == [m["merges_applied"] for m in b.metrics]


@pytest.mark.parametrize("batch", [None, 1])
def test_spark_engine_equals_memory(spark, batch):
    rng = random.Random(5)
    for _ in range(3):
        words = [w for _ in range(12) for w in random_words(rng)]
        df = spark.createDataFrame(words, "word string, weight long").groupBy("word").agg(F.sum("weight").alias("weight"))
        config = toy({"vocab_size": 275, "min_frequency": 3})
        a, b = (train.train_on_words(df, config, engine, batch) for engine in ("memory", "spark"))
        assert a.merges == b.merges and a.tokens == b.tokens and a.stop_reason == b.stop_reason
        assert [m["merges_applied"] for m in a.metrics] == [m["merges_applied"] for m in b.metrics]


@pytest.fixture(scope="module")
def trained(spark):
    text = ("The quick brown fox jumps over the lazy dog; then they thought the other thing.\n" * 20).encode() + bytes(range(256))
    return text, train.train(sources.in_memory(spark, [text]), TrainerConfig(vocab_size=380, min_frequency=2, custom_specials=("<|own|>",)))


def test_files(spark, trained, tmp_path):
    text, model = trained
    path = str(tmp_path / "t.json")
    model.save(path)
    hf, back = Tokenizer.from_file(path), load(path)
    assert back.tokens == model.tokens and back.merges == model.merges and back.special_ids["<|own|>"] == 312
    for data in (text, b"q<|start|>q<|own|>", b"the then"):
        expected = hf.encode(data.decode("utf-8", "replace")).ids
        if data.decode("utf-8", "replace").encode() == data:
            assert codec.encoder(model)(data) == expected
    found = info(path)
    assert found["reasoning_tokens"]["matches"] and found["total_vocab_size"] == 380 and found["merges"] == len(model.merges)
    paths = model.save_family(path, [340, 320, 340], "small-{size}.json")
    assert [p.rsplit("/")[-1] for p in paths] == ["small-320.json", "small-340.json"] and load(paths[0]).size == 320
    with pytest.raises(ValueError):
        model.derived(100)
    assert model.derived(330).merges == model.merges[: 330 - 313]
    assert merge_overlap(model, model.derived(330), 10)["top"] == 10 and token_lengths(model)["avg_len"] > 1
    assert {r.kind for r in model.vocabulary(spark).collect()} == {"leading", "byte", "reasoning", "custom", "merge"} | ({"padding"} if model.size > model.config.base_size + len(model.merges) else set())
    assert vocab_stats(model.vocabulary(spark)).first()["token_count"] == 380


def test_encoding_and_decoding(spark, trained):
    text, model = trained
    values = [text, b"", b"<|start|>x<|own|>", bytes(range(256)) * 3, b"\xff\xfe the"]
    df = spark.createDataFrame([(bytearray(v),) for v in values] + [(None,)], "content binary")
    f = codec.encoder(model)
    folded = codec.encode(df, model)
    assert [r.tokens for r in folded.collect()] == [f(v) for v in values] + [None]
    heap = {None if r.content is None else bytes(r.content): r.tokens for r in df.withColumn("tokens", codec.heaped(F.col("content"), model)).collect()}
    assert heap == {v: f(v) for v in values} | {None: None}
    back = codec.decode(folded, model, out="back").collect()
    assert [r.back for r in back] == [*values, None]
    skipped = codec.decode(folded, model, out="back", skip_special=True).collect()
    assert skipped[2].back == b"x"
    with pytest.raises(Exception, match="outside the vocabulary"):
        codec.decode(spark.createDataFrame([([999],)], "tokens array<int>"), model).collect()
    plain = codec.encode(df, model, literals=False).collect()[2].tokens
    assert len(plain) > 3


def test_legacy_files(tmp_path):
    data = bytes([0, 0xAB, 0xBB, 0xAD, 0xFF])
    for escaped in (False, True):
        over = {0xAB: "", 0xBB: ""} if escaped else {}
        vocab = {over.get(b, chr(b)): b + 1 for b in range(256)} | {"<|start|>": 0, "«": 300, "»": 301} if escaped else {chr(b): b + 1 for b in range(256)} | {"<|start|>": 0}
        path = tmp_path / f"{escaped}.json"
        path.write_text(json.dumps({"added_tokens": [{"id": 0, "content": "<|start|>", "special": True}], "model": {"type": "BPE", "vocab": vocab, "merges": []}}))
        model = load(str(path))
        ids = codec.encoder(model)(data)
        assert b"".join(model.tokens[i] for i in ids) == data and ids == [b + 1 for b in data]


@pytest.mark.parametrize("mode", ["first", "frequency", "support", "entropy"])
def test_chunk_training(spark, mode):
    rng = random.Random(8)
    common = b"the thing that they thought " * 30
    chunks = [common + bytes(rng.choice(b"abc ") for _ in range(300)) for _ in range(3)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate([*chunks, chunks[0], b""])], "index long, content binary")
    config = TrainerConfig(vocab_size=300, min_frequency=2, reasoning=False)
    result = chunked.train_chunks(df, config, mode, "count")
    assert result.report["duplicates_reused"] == 1 and result.chunks.count() == 4 and result.model.merges
    assert chunked.train_chunks(df, config, mode, "unique").report["duplicates_skipped"] == 1
    t = result.model.tokens
    assert all(t[a] + t[b] == t[263 + r] for r, (a, b) in enumerate(result.model.merges))
    assert all(json.loads(c)["merge_count"] > 0 for c in chunked.chunk_reports(result))
    with pytest.raises(ValueError):
        chunked.train_chunks(df, config, mode, low=7.9)


def test_assembly_waits_for_parts():
    config = TrainerConfig(vocab_size=270, reasoning=False)
    model, done = chunked.assembled([(b"ab", b"c"), (b"a", b"b"), (b"a", b"bc"), (b"x", b"yz")], config)
    assert model.tokens[263:] == [b"ab", b"abc"]
    assert done == {"merges_requested": 7, "merges_realized": 2, "duplicates_skipped": 0, "missing_dependencies": 2}


def test_stream_counts_words(spark, tmp_path):
    from byteloom.streaming import stream_word_counts, word_counts

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    sources.in_memory(spark, [b"a b a", b"b\n"]).write.parquet(folder)
    query = stream_word_counts(spark.readStream.schema("content binary").parquet(folder), Segmentation("ascii"), out, str(tmp_path / "c"))
    query.processAllAvailable()
    sources.in_memory(spark, [b"a"]).write.mode("append").parquet(folder)
    query.processAllAvailable()
    query.stop()
    counted = word_counts(spark, out)
    assert {r.word: r.weight for r in counted.collect()} == {"a": 3, "b": 2, " ": 2, "\n": 1}
    model = train.train_on_words(counted, toy())
    assert model.size == 270


def test_metrics_of_both_engines(spark):
    words = spark.createDataFrame([("the", 9), ("then", 5), ("hen", 4), ("aaaa", 3)], "word string, weight long")
    for engine in ("memory", "spark"):
        model = train.train_on_words(words, TrainerConfig(vocab_size=270, min_frequency=2, reasoning=False), engine)
        m = model.metrics
        assert [x["iteration"] for x in m] == list(range(1, len(m) + 1)) and all(x["distinct_pairs"] > 0 for x in m[:-1])
        total = [x["elapsed_total"] for x in m]
        assert total == sorted(total) and abs(sum(x["elapsed_iteration"] for x in m) - total[-1]) < 1e-6
        assert model.seconds >= total[-1] and all(x["rss_kb"] > 0 for x in m)


def test_token_counts_of_several_models(spark, trained):
    text, model = trained
    rows = [b"the th", bytes([0xE9, 0x20, 0x80]), "é ü".encode(), b""]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(rows)], "i int, content binary")
    out = {r.i: r for r in codec.compared(df, {"a": model, "b": model.derived(model.config.base_size)}).collect()}
    f = codec.encoder(model)
    assert out[0].a == len(f(rows[0])) and out[0].b == 6 and out[3].a == 0
    assert out[1].b == 5  # no UTF-8, so read as Latin-1: two characters of two bytes and a space
    assert out[2].b == 5
    assert [r.n_tokens for r in codec.token_counts(df, model.derived(model.config.base_size), first_bytes=1).orderBy("i").collect()] == [1, 2, 2, 0]


def test_tokens_over_edges_of_white_space_are_encoded_whole():
    config = TrainerConfig(vocab_size=265, reasoning=False)
    model = Model([*kernel.Decider(config).out.tokens, b" b", b"a b"], [(7 + 32, 7 + 98), (7 + 97, 263)], config)
    assert codec.encoder(model)(b"a b") == [264]


def test_query_of_the_spark_loop_gives_all_merges_of_train_merges(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(60)), "s") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    whole, loop = (catalog.queries()[name](spark, str(tmp_path)) for name in ("train_merges", "train_merges_spark"))
    expected = sorted(tuple(r) for r in whole.select(*loop.columns).collect())
    assert len(expected) == 88 and sorted(tuple(r) for r in loop.collect()) == expected


def test_counting_in_batches_equals_cutting_one_by_one(spark):
    rng = random.Random(4)
    parts = [b"a", b"bc", b" ", b"\t\n", b"\0", b"\0\0", b"\xc2", b"\xa0", b"\xc2\xa0", b"\xe2\x80", b"\x83", b"\xe3\x80\x80", b"\xe1\x9a\x80", b"\x85"]
    values = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = sources.in_memory(spark, values).coalesce(2)
    for mode in ("none", "ascii", "unicode", "null"):
        one_by_one = df.select(F.explode(segment.runs(F.col("content"), mode)).alias("word")).groupBy("word").count()
        expected = {r.word: r["count"] for r in one_by_one.collect()}
        assert {r.word: r.weight for r in segment.words(df, Segmentation(mode)).collect()} == expected
