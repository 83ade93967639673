"""Whole runs of the command line."""

import gzip
import json

import pytest

from byteloom import cli

FEW = ["--no-progress", "--disable-reasoning-tokens"]


@pytest.fixture
def run(spark, tmp_path, monkeypatch, capsys):
    """Runs a command in an empty folder and gives what it prints."""
    monkeypatch.chdir(tmp_path)

    def go(*args):
        capsys.readouterr()
        cli.main(["--quiet", *args])
        return capsys.readouterr().out

    return go


def model(path):
    return json.loads(path.read_text())


CYCLE = bytes(range(256)) * 16


def test_train_encode_decode(run, tmp_path):
    (tmp_path / "input.bin").write_bytes(CYCLE)
    run("train", "input.bin", "--vocab-size", "270", "--min-frequency", "2", *FEW, "--chunk-size", "1024", "-o", "tokenizer.json")
    for more in ([], ["--add-special-tokens"]):
        ids = json.loads(run("encode", "-m", "tokenizer.json", "input.bin", "--json", *more))["tokens"]
    assert ids
    run("decode", "-m", "tokenizer.json", "--output", "decoded.bin", "--skip-special-tokens", *map(str, ids))
    assert (tmp_path / "decoded.bin").read_bytes() == CYCLE
    (tmp_path / "ids").write_text("\n".join(map(str, ids)))
    run("decode", "-m", "tokenizer.json", "--output", "again.bin", "--input", "ids")
    assert (tmp_path / "again.bin").read_bytes() == CYCLE
    assert "Total vocab" in run("info", "-m", "tokenizer.json")


def test_special_tokens_come_first(run, tmp_path):
    (tmp_path / "a").write_bytes(b"special tokens " * 30)
    run("train", "a", "--vocab-size", "300", "--min-frequency", "2", *FEW, "--chunk-size", "0", "--special-token", "<|custom-special|>", "-o", "t.json")
    found = json.loads(run("info", "-m", "t.json", "--json"))["special_token_ids"]
    assert sorted(found.values())[:7] == list(range(7)) and found["<|start|>"] == 0 and found["<|custom-special|>"] == 263


@pytest.mark.parametrize("packed", [False, True])
def test_json_lines(run, tmp_path, packed):
    lines = "".join(json.dumps({"text": t}) + "\n" for t in ("foo bar foo bar", "", "baz qux foo")).encode()
    name = "d.jsonl.gz" if packed else "d.jsonl"
    (tmp_path / name).write_bytes(gzip.compress(lines) if packed else lines)
    run("train", "--jsonl", f"{tmp_path / name}:text", "--vocab-size", "270", "--min-frequency", "1", "--chunk-size", "0", *FEW, "-o", "t.json")
    assert len(model(tmp_path / "t.json")["model"]["vocab"]) == 270


@pytest.mark.parametrize("mode", ["first", "frequency", "support", "entropy"])
def test_chunk_train(run, tmp_path, mode):
    (tmp_path / "c.bin").write_bytes(bytes(range(64)) * 32)
    run("chunk-train", "c.bin", "--vocab-size", "280", "--min-frequency", "2", "--chunk-size", "512", "--combine-mode", mode, "--disable-reasoning-tokens", "--output", "out/c.json", "--report", "out/r.json")
    report = model(tmp_path / "out/r.json")
    assert report["chunks"] and report["combine_mode"] == mode and report["combine_stats"]["merges_realized"] > 0


def test_repeated_chunks(run, tmp_path):
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(b"\x2a" * 512)
    for how, total, skipped, reused in (("unique", 1, 1, 0), ("count", 2, 0, 1)):
        run("chunk-train", "a.bin", "b.bin", "--chunk-size", "512", "--duplicates", how, "--no-progress", "--output", "c.json", "--report", "r.json")
        r = model(tmp_path / "r.json")
        assert (r["total_chunks"], r["duplicates_skipped"], r["duplicates_reused"]) == (total, skipped, reused)
    (tmp_path / "r.json").unlink()
    run("chunk-train", "a.bin", "--chunk-size", "512", "--no-report", "--output", "c.json")
    assert not (tmp_path / "chunk_train_report.json").exists() and not (tmp_path / "r.json").exists()


def test_families_in_a_folder_of_their_own(run, tmp_path):
    (tmp_path / "text.bin").write_bytes(b"foo  bar\tbaz\nqux\x00wumpus   llama")
    sizes = ["--family-size", "264", "--family-size", "280", "--family-template", "variants/family-{size}.json"]
    run("train", "text.bin", "--vocab-size", "300", "--min-frequency", "1", "--chunk-size", "0", *FEW, "--preprocessor", "ascii-whitespace", *sizes, "-o", "t.json")
    assert model(tmp_path / "t.json")["pre_tokenizer"]["type"] == "Sequence"
    for size in (264, 280):
        assert len(model(tmp_path / f"variants/family-{size}.json")["model"]["vocab"]) == size


@pytest.mark.parametrize("p", ["0.5", "0"])
def test_cuts_by_chance_are_not_written(run, tmp_path, p):
    (tmp_path / "p.bin").write_bytes(b"foo bar baz qux")
    chance = ["--preprocessor", "ascii-whitespace", "--preprocessor-probability", p, "--preprocessor-seed", "1337"]
    run("train", "p.bin", "--vocab-size", "300", "--min-frequency", "1", "--chunk-size", "0", *FEW, *chance, "-o", "p.json")
    assert model(tmp_path / "p.json")["pre_tokenizer"]["type"] == "ByteLevel"


@pytest.mark.parametrize("mode", ["ascii-whitespace", "unicode-whitespace", "null-delimited"])
def test_preprocessors_come_back(run, tmp_path, mode):
    data = "foo  bar\tbaz qux\0\0wumpus llama".encode() * 5
    (tmp_path / "x").write_bytes(data)
    run("train", "x", "--vocab-size", "290", "--min-frequency", "2", "--chunk-size", "0", *FEW, "--preprocessor", mode, "-o", "t.json")
    ids = json.loads(run("encode", "-m", "t.json", "x", "--json"))["tokens"]
    run("decode", "-m", "t.json", "-o", "back", *map(str, ids))
    assert (tmp_path / "back").read_bytes() == data
    from byteloom.model import load

    assert load(str(tmp_path / "t.json")).config.segmentation.mode == cli.PREPROCESSORS[mode]


def test_info_of_reasoning_tokens(run, tmp_path):
    (tmp_path / "x").write_text("⧈ ⚖ ⏵ ✦ " * 20)
    for flags, matches in ((["--no-progress"], True), (FEW, False)):
        run("train", "x", "--vocab-size", "330", "--min-frequency", "2", "--chunk-size", "0", *flags, "-o", "t.json")
        found = json.loads(run("info", "-m", "t.json", "--json"))["reasoning_tokens"]
        assert found["matches"] == matches and len(found["mismatches"]) == (0 if matches else 49)


@pytest.mark.parametrize("bounds", [["--max-entropy", "7.0"], ["--min-entropy", "0.5"], ["--min-entropy", "0.5", "--max-entropy", "8.0"]])
def test_entropy_bounds(run, tmp_path, bounds):
    (tmp_path / "z").write_bytes(bytes(1024))
    (tmp_path / "c").write_bytes(CYCLE)
    (tmp_path / "t").write_bytes(b"the quick brown fox " * 60)
    run("train", "z", "c", "t", "--vocab-size", "270", *bounds, *FEW, "--chunk-size", "512", "-o", "t.json")
    assert len(model(tmp_path / "t.json")["model"]["vocab"]) == 270


@pytest.mark.parametrize("bounds", [["7.0", "0.5"], ["7.5", "7.6"]])
def test_bounds_that_leave_nothing_fail(run, tmp_path, bounds):
    (tmp_path / "c").write_bytes(CYCLE)
    with pytest.raises(ValueError):
        run("train", "c", "--vocab-size", "270", "--min-entropy", bounds[0], "--max-entropy", bounds[1], *FEW, "--chunk-size", "512", "-o", "t.json")
    assert not (tmp_path / "t.json").exists()


def test_outputs_of_files_with_one_name(run, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x").write_bytes(folder.encode() * 40)
    run("train", "a", "b", "--vocab-size", "270", "--min-frequency", "2", *FEW, "-o", "t.json")
    run("encode", "-m", "t.json", "a/x", "b/x", "--output-dir", "ids")
    assert len(list((tmp_path / "ids").iterdir())) == 2


def test_both_algorithms_and_the_report_of_speed(run, tmp_path, capsys):
    (tmp_path / "x").write_bytes(b"the thing that they thought " * 40)
    found = []
    for algorithm in ("fast", "low-memory"):
        capsys.readouterr()
        cli.main(["train", "x", "--vocab-size", "290", "--min-frequency", "2", *FEW, "--algorithm", algorithm, "--threads", "2", "--pretty", "-o", f"{algorithm}.json"])
        assert "MiB/s" in capsys.readouterr().out
        found.append(model(tmp_path / f"{algorithm}.json"))
    assert found[0] == found[1]
