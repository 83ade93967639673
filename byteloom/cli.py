"""Command line: train, chunk-train, encode, decode, info."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import time

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from byteloom import model as models
from byteloom import sources
from byteloom.config import MODES, Ingest, Segmentation, TrainerConfig
from byteloom.operators import codec, stats
from byteloom.plans import chunked, train


PREPROCESSORS = {"none": "none", "ascii-whitespace": "ascii", "unicode-whitespace": "unicode", "null-delimited": "null"}
#: fast trains in memory where the words are few; low-memory keeps the merge loop on Spark. Both give the same merges.
ALGORITHMS = {"fast": "auto", "low-memory": "spark"}
NAMES = {"base_vocab_size": "Base vocab", "special_vocab_size": "Special vocab", "total_vocab_size": "Total vocab"}
LEGACY = ("auto", "plain", "escaped")


def _session(args: argparse.Namespace) -> SparkSession:
    master = f"local[{args.threads}]" if getattr(args, "threads", None) and args.master == "local[*]" else args.master
    progress = args.verbose > 0 and not args.quiet and not getattr(args, "no_progress", False)
    spark = SparkSession.builder.master(master).appName("byteloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", str(progress).lower()).getOrCreate()
    spark.sparkContext.setLogLevel("OFF" if args.quiet else "INFO" if args.verbose > 1 else "WARN" if args.verbose else "ERROR")
    return spark


def _training(p: argparse.ArgumentParser) -> None:
    p.add_argument("--vocab-size", type=int, default=32_768)
    p.add_argument("--min-frequency", type=int, default=4)
    p.add_argument("--allowed-length", type=int, action="append", metavar="LEN")
    p.add_argument("--special-token", action="append", default=[], metavar="TOKEN")
    p.add_argument("--disable-reasoning-tokens", action="store_true")
    p.add_argument("--algorithm", choices=ALGORITHMS, default="fast")
    p.add_argument("--preprocessor", choices=PREPROCESSORS, default="none")
    p.add_argument("--preprocessor-probability", type=float, default=1.0, metavar="P")
    p.add_argument("--preprocessor-seed", type=int, default=0, metavar="SEED")
    p.add_argument("--max-merge-iterations", type=int, metavar="COUNT")
    p.add_argument("--min-entropy", type=float, metavar="BITS")
    p.add_argument("--max-entropy", type=float, metavar="BITS")
    p.add_argument("--threads", type=int, metavar="N")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--follow-symlinks", action="store_true")
    p.add_argument("--no-progress", action="store_true")
    p.add_argument("--family-size", type=int, action="append", default=[], metavar="SIZE")
    p.add_argument("--family-template", metavar="PATTERN")
    p.add_argument("--whitespace-merges-require-letter", action="store_true")
    p.add_argument("--forbid-leading-whitespace-merges", action="store_true")


def _config(args: argparse.Namespace, **more: object) -> TrainerConfig:
    lengths = {*args.allowed_length, 1} if args.allowed_length else None
    return TrainerConfig(
        vocab_size=args.vocab_size,
        min_frequency=args.min_frequency,
        allowed_lengths=tuple(lengths) if lengths else None,
        segmentation=Segmentation(PREPROCESSORS[args.preprocessor], args.preprocessor_probability, args.preprocessor_seed),
        custom_specials=tuple(args.special_token),
        reasoning=not args.disable_reasoning_tokens,
        max_iterations=args.max_merge_iterations,
        require_letter=args.whitespace_merges_require_letter,
        forbid_leading_space=args.forbid_leading_whitespace_merges,
        **more,
    )


def parser() -> argparse.ArgumentParser:
    everywhere = argparse.ArgumentParser(add_help=False)
    for name, action in (("verbose", "count"), ("quiet", "count")):
        everywhere.add_argument(f"-{name[0]}", f"--{name}", action=action, default=argparse.SUPPRESS)
    everywhere.add_argument("--master", default=argparse.SUPPRESS)
    out = argparse.ArgumentParser(prog="byteloom", parents=[everywhere])
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=text, parents=[everywhere])

    p = command("train", "train one vocabulary on files and JSON lines")
    p.add_argument("inputs", nargs="*")
    p.add_argument("--output", "-o", default="tokenizer.json")
    _training(p)
    p.add_argument("--chunk-size", type=int, default=8192, metavar="BYTES")
    p.add_argument("--jsonl", action="append", default=[], metavar="PATH:FIELD")
    p.add_argument("--plateau-stop", action="store_true")
    p.add_argument("--plateau-floor", type=int, default=128)
    p.add_argument("--plateau-patience", type=int, default=32)
    p.add_argument("--plateau-divisor", type=int, default=512)
    p.add_argument("--pretty", action="store_true")
    p = command("chunk-train", "train on every chunk and combine")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--output", "-o", default="chunked-tokenizer.json")
    _training(p)
    p.add_argument("--chunk-size", type=int, default=32 << 20, metavar="BYTES")
    p.add_argument("--combine-mode", choices=chunked.MODES, default="support")
    p.add_argument("--duplicates", choices=chunked.DUPLICATES, default="count")
    p.add_argument("--report", default="chunk_train_report.json", metavar="PATH")
    p.add_argument("--no-report", action="store_true")
    p = command("encode", "write the ids of files")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--tokenizer", "-m", required=True, metavar="PATH")
    p.add_argument("--output-dir", metavar="DIR")
    p.add_argument("--json", action="store_true")
    p.add_argument("--add-special-tokens", action="store_true", help="accepted; files name no tokens that go around a text")
    p.add_argument("--legacy-byte-behavior", choices=LEGACY, default="auto")
    p.add_argument("--no-literals", action="store_true")
    p = command("decode", "write the bytes of ids")
    p.add_argument("tokens", nargs="*", metavar="ID")
    p.add_argument("--tokenizer", "-m", required=True, metavar="PATH")
    p.add_argument("--input", metavar="PATH")
    p.add_argument("--output", "-o", metavar="PATH")
    p.add_argument("--skip-special-tokens", action="store_true")
    p.add_argument("--legacy-byte-behavior", choices=LEGACY, default="auto")
    p = command("info", "describe a tokenizer.json")
    p.add_argument("--tokenizer", "-m", required=True, metavar="PATH")
    p.add_argument("--json", action="store_true")
    return out


def _saved(model: models.Model, args: argparse.Namespace, size: int | None = None, seconds: float | None = None) -> None:
    pretty = getattr(args, "pretty", False)
    model.save(args.output, pretty)
    if args.family_size:
        model.save_family(args.output, args.family_size, args.family_template, pretty)
    if not args.quiet:
        print(f"{args.output}: {model.size} tokens, {len(model.merges)} merges, {model.stop_reason or 'combined'}")
        if size is not None and seconds:
            mib = size / (1 << 20)
            print(f"{mib:.2f} MiB in {seconds:.2f} s, {mib / seconds:.2f} MiB/s")


def _train(args: argparse.Namespace) -> None:
    spark = _session(args)
    ingest = Ingest(args.chunk_size, not args.no_recursive, args.follow_symlinks)
    parts = [sources.binary_files(spark, args.inputs, ingest)] if args.inputs else []
    parts += [sources.jsonl(spark, j) for j in args.jsonl]
    if not parts:
        raise SystemExit("name files, folders or --jsonl inputs")
    config = _config(args, plateau=args.plateau_stop, plateau_floor=args.plateau_floor, plateau_patience=args.plateau_patience, plateau_divisor=args.plateau_divisor)
    began, read = time.perf_counter(), []
    for i, p in enumerate(parts):
        # The bytes read are counted on the way, before sequences are left out.
        read.append(Observation())
        seen = p.select("content").observe(read[-1], F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
        parts[i] = stats.entropy_window(seen, args.min_entropy, args.max_entropy)
    model = train.train_on_union(parts, config, engine=ALGORITHMS[args.algorithm])
    _saved(model, args, sum(o.get["bytes"] for o in read), time.perf_counter() - began)


def _chunk_train(args: argparse.Namespace) -> None:
    spark = _session(args)
    ingest = Ingest(args.chunk_size, not args.no_recursive, args.follow_symlinks)
    if args.chunk_size <= 0:
        raise SystemExit("chunks have a size")
    # Chunks are numbered by the place of their file in sorted order, and by their place in it.
    paths = [(p if "://" in p else f"file:{os.path.abspath(p)}", i) for i, p in enumerate(sources.list_paths(args.inputs, ingest))]
    places = spark.createDataFrame(paths, "source string, place long")
    files = sources.binary_files(spark, args.inputs, ingest).join(places, "source")
    chunks = files.select((F.col("place") * (1 << 24) + F.col("chunk_index")).alias("index"), "content")
    result = chunked.train_chunks(chunks, _config(args), args.combine_mode, args.duplicates, args.min_entropy, args.max_entropy)
    _saved(result.model, args)
    if not args.no_report:
        os.makedirs(os.path.dirname(os.path.abspath(args.report)), exist_ok=True)
        with open(args.report, "w") as f:
            json.dump(result.report | {"chunks": [json.loads(c) for c in chunked.chunk_reports(result)]}, f, indent=2)


def _encode(args: argparse.Namespace) -> None:
    spark = _session(args)
    model = models.load(args.tokenizer, args.legacy_byte_behavior)
    whole = sources.binary_files(spark, args.inputs, Ingest(0))
    taken: set[str] = set()
    for r in codec.encode(whole, model, literals=not args.no_literals).select("source", "tokens").orderBy("source").toLocalIterator():
        path = re.sub("^file:/+", "/", r.source)
        if args.output_dir:
            os.makedirs(args.output_dir, exist_ok=True)
            # Files of one name in different folders get the folders into their names.
            name = os.path.basename(path)
            name = name if name not in taken else path.strip("/").replace("/", "__")
            taken.add(name)
            with open(os.path.join(args.output_dir, name + ".tokens"), "w") as f:
                f.write(" ".join(map(str, r.tokens)) + "\n")
        elif args.json:
            print(json.dumps({"path": path, "tokens": list(r.tokens)}))
        else:
            print(f"{path}:\t{' '.join(map(str, r.tokens))}")


def _decode(args: argparse.Namespace) -> None:
    if not args.tokens and not args.input:
        raise SystemExit("name ids or --input")
    spark = _session(args)
    model = models.load(args.tokenizer, args.legacy_byte_behavior)
    text = " ".join(args.tokens)
    if args.input:
        with open(args.input) as f:
            text = f.read()
    ids = spark.createDataFrame([(text,)], "t string").select(sources.token_lists(F.col("t")).alias("tokens"))
    out = bytes(codec.decode(ids, model, skip_special=args.skip_special_tokens).first()["content"])
    if args.output:
        with open(args.output, "wb") as f:
            f.write(out)
    else:
        sys.stdout.buffer.write(out)


def _info(args: argparse.Namespace) -> None:
    found = models.info(args.tokenizer)
    if args.json:
        print(json.dumps(found, indent=2, ensure_ascii=False))
        return
    r = found.pop("reasoning_tokens")
    found.pop("special_token_ids")
    for name, value in found.items():
        print(f"{NAMES.get(name, name.replace('_', ' ').capitalize()):20} {', '.join(value) if isinstance(value, list) else value}")
    print(f"{'Reasoning tokens':20} " + (f"{r['count']} from id {r['offset']}" if r["matches"] else f"{len(r['mismatches'])} of {r['count']} missing or misplaced"))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    for name, value in (("verbose", 0), ("quiet", 0), ("master", "local[*]")):
        setattr(args, name, getattr(args, name, value))
    {"train": _train, "chunk-train": _chunk_train, "encode": _encode, "decode": _decode, "info": _info}[args.command](args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
