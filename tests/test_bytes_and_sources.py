import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from byteloom import layout, sources
from byteloom.config import Ingest, TrainerConfig
from byteloom.functions import bytes as fb
from byteloom.operators import stats

ALL = bytes(range(256))


@pytest.mark.parametrize("encoding", [fb.PLAIN, fb.LEGACY, fb.GPT2])
def test_all_bytes_come_back(spark, encoding):
    df = spark.createDataFrame([(bytearray(ALL),), (bytearray(b""),), (None,)], "b binary")
    out = df.select("b", fb.encode_bytes(F.col("b"), encoding).alias("s"))
    rows = out.select("b", "s", fb.decode_string(F.col("s"), encoding).alias("back")).collect()
    assert [r.back for r in rows] == [r.b for r in rows]
    assert rows[0].s == fb.encode_py(ALL, encoding) and fb.decode_py(rows[0].s, encoding) == ALL


def test_unknown_characters(spark):
    df = spark.createDataFrame([("ab",), ("a b",)], "s string")
    assert [r[0] for r in df.select(fb.try_decode_string(F.col("s"))).collect()] == [b"ab", None]
    with pytest.raises(Exception, match="byte alphabet"):
        df.select(fb.decode_string(F.col("s"))).collect()
    assert fb.decode_py("a b") is None


def test_legacy_overrides_are_two_quotes():
    assert fb.legacy_overrides() == {0xAB: "", 0xBB: ""}


def test_predicates(spark):
    rows = [b"", b" ", b"a ", b" a", b"\n\x0b", b"1\n", b"x", b"a b"]
    df = spark.createDataFrame([(bytearray(r),) for r in rows], "b binary")
    b = F.col("b")
    got = df.select(fb.is_space(b), fb.starts_with_space(b), fb.ends_with_space(b), fb.has_letter(b), fb.has_space(b)).collect()
    ws = fb.SPACES
    for r, g in zip(rows, got):
        letter = any(chr(x).isalpha() for x in r)
        assert tuple(g) == (bool(r) and all(x in ws for x in r), r[:1] != b"" and r[0] in ws, r[-1:] != b"" and r[-1] in ws, letter, any(x in ws for x in r))


def test_refused_tokens():
    assert fb.refused(b"a ") and not fb.refused(b"  ") and not fb.refused(b" a")
    assert fb.refused(b" a", forbid_leading=True) and fb.refused(b"1 2", require_letter=True) and not fb.refused(b"1 b", require_letter=True)


def test_characters_follow_ids():
    ids = [7, 262, 263, 7 + 0xD7FF, 7 + 0xD800, 7 + 0xF000, 7 + 0x12000]
    chars = [layout.char_of(i) for i in ids]
    assert [layout.id_of(c) for c in chars] == ids and chars == sorted(chars)
    assert not any(0xD800 <= ord(c) <= 0xE000 for c in chars)
    assert [layout.id_of(layout.char_of(i)) for i in range(7)] == list(range(7))
    assert len(layout.REASONING) == 49 and len(set(layout.REASONING)) == 49


def test_config():
    assert TrainerConfig().base_size == 312 and TrainerConfig(reasoning=False).base_size == 263
    for bad in ({"vocab_size": 300}, {"min_frequency": 0}, {"allowed_lengths": (2, 3)}, {"plateau_divisor": 0}, {"custom_specials": ("★",)}):
        with pytest.raises(ValueError):
            TrainerConfig(**bad)


def test_chunks_and_totals(spark, tmp_path):
    (tmp_path / "a").write_bytes(bytes(range(10)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b").write_bytes(b"xyz")
    (tmp_path / "sub" / "empty").write_bytes(b"")
    root = str(tmp_path)
    rows = sources.binary_files(spark, [root], Ingest(4)).orderBy("source", "chunk_index").collect()
    assert [bytes(r.content) for r in rows] == [bytes(range(4)), bytes(range(4, 8)), bytes([8, 9]), b"xyz"]
    assert tuple(sources.totals(spark, [root], Ingest(4)).first()) == (4, 13)
    assert sources.binary_files(spark, [root], Ingest(0, recursive=False)).count() == 1
    os.symlink(tmp_path / "a", tmp_path / "link")
    assert len(sources.list_paths([root])) == 3 and len(sources.list_paths([root], Ingest(follow_symlinks=True))) == 4
    for bad in ([root + "/none"], [root + "/link"]):
        with pytest.raises((FileNotFoundError, ValueError)):
            sources.list_paths(bad)


def test_files_in_ranges_and_uris(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b").write_bytes(b"xy")
    for size, step in ((100, 350), (100, 1), (4096, 1 << 20)):
        for inputs in ([str(tmp_path)], [f"file://{tmp_path}"], [f"file://{tmp_path}/a", f"file://{tmp_path}/b"]):
            rows = sources.binary_files(spark, inputs, Ingest(size), range_bytes=step).orderBy("source", "chunk_index").collect()
            assert b"".join(bytes(r.content) for r in rows) == data + b"xy"
            assert [r.chunk_index for r in rows] == [*range(-(-len(data) // size)), 0] and all(len(r.content) <= size for r in rows)
    with pytest.raises(FileNotFoundError):
        sources.list_paths([f"file://{tmp_path}/none"])


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\nc"), (1, "a"), (3, None)], "i int, text string")
    sources.export_texts(df, str(tmp_path / "out"), order="i")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "a\n\nb\nc\n\n"


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "x.jsonl.gz")
    with gzip.open(path, "wt") as f:
        f.write("\n".join([json.dumps({"a": {"b": t}, "c": [{"t": "in"}], "n": 1}) for t in ("alpha", "", "beta gamma")]) + "\n\n")
    assert sources.parse_spec(f"{path}: a . b ") == (path, ["a", "b"])
    assert sorted(bytes(r.content) for r in sources.jsonl(spark, f"{path}:a.b", 2).collect()) == [b"alpha", b"beta gamma"]
    assert [bytes(r.content) for r in sources.jsonl(spark, f"{path}:c[0].t").collect()] == [b"in"] * 3
    for field in ("n", "missing"):
        with pytest.raises(Exception, match="no string"):
            sources.jsonl(spark, f"{path}:{field}").collect()
    with pytest.raises(ValueError):
        sources.parse_spec("no field")
    lists = spark.createDataFrame([(" 1 22\n3 ",), ("",)], "t string").select(sources.token_lists(F.col("t")).alias("x"))
    assert [r.x for r in lists.collect()] == [[1, 22, 3], []]


def test_entropy(spark):
    values = [b"", b"a" * 9, ALL * 2, b"aab", b"\n\n\0"]
    df = sources.in_memory(spark, values)
    got = [r.entropy for r in stats.with_entropy(df).collect()]
    assert [round(x, 9) for x in got] == [0, 0, 8, 0.918295834, 0.918295834]
    assert stats.entropy_window(df, 0.5, None).count() == 3 and stats.entropy_window(df, None, 7.0).count() == 4
    with pytest.raises(ValueError):
        stats.entropy_window(df, 7.0, 0.5)


def test_dedup_and_weights(spark):
    df = spark.createDataFrame([(3, bytearray(b"x")), (1, bytearray(b"y")), (2, bytearray(b"x"))], "index long, content binary")
    assert {r["index"]: r.first_index for r in stats.deduplicated(df, "index").collect()} == {1: 1, 2: 2, 3: 2}
    w = spark.createDataFrame([(1, 100, 8.0), (2, 100, 0.0), (3, 400, 4.0)], "i int, byte_len long, entropy double")
    raw = [1.0 * (100 / 200) ** 0.5, 0.1 * (100 / 200) ** 0.5, 0.5 * 2**0.5]
    assert [round(r.weight, 9) for r in stats.chunk_weights(w).orderBy("i").collect()] == [round(x / sum(raw), 9) for x in raw]
