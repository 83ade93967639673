"""A trained vocabulary: its tables, smaller versions, statistics and files."""

from __future__ import annotations

import json
import os
import statistics
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom import layout
from byteloom.config import Segmentation, TrainerConfig
from byteloom.functions.bytes import GPT2, LEGACY, PLAIN, decode_py, encode_py, legacy_overrides

_SPACE_RUN = {"ascii": "[ \\t\\n\\r\\x0B\\x0C]+", "null": "\\x00+"}
_UNICODE_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_SPACE_RUN["unicode"] = "[" + "".join(f"\\x{{{c:04X}}}" for c in _UNICODE_SPACES) + "]+"


@dataclass
class Model:
    """tokens: bytes by id; merges by rank; metrics, a row a merge; special ids hold their string's UTF-8."""

    tokens: list[bytes]
    merges: list[tuple[int, int]]
    config: TrainerConfig
    metrics: list[dict] = field(default_factory=list)
    stop_reason: str | None = None
    #: Seconds of the training.
    seconds: float | None = None
    #: Ids that special-token literals stand for.
    special_ids: dict[str, int] = field(default_factory=dict)
    encoding: str = GPT2
    overrides: dict[int, str] = field(default_factory=dict)
    #: id by which each rank's merge result is known, if it isn't the base size plus the rank.
    results: list[int] | None = None

    def __post_init__(self) -> None:
        if not self.special_ids:
            self.special_ids = {t: i for i, t in enumerate(layout.LEADING)}
            first = layout.FIRST_TRAILING + (len(layout.REASONING) if self.config.reasoning else 0)
            self.special_ids |= {t: first + i for i, t in enumerate(self.config.custom_specials)}

    @property
    def size(self) -> int:
        return len(self.tokens)

    def result(self, rank: int) -> int:
        return self.results[rank] if self.results is not None else self.config.base_size + rank

    def kind(self, token: int) -> str:
        first = layout.FIRST_TRAILING
        glyphs = len(layout.REASONING) if self.config.reasoning else 0
        if token < layout.FIRST_BYTE:
            return "leading"
        if token < first:
            return "byte"
        if token < first + glyphs:
            return "reasoning"
        if token < self.config.base_size:
            return "custom"
        return "merge" if token < self.config.base_size + len(self.merges) else "padding"

    def string(self, token: int) -> str:
        """How a token is written in files: specials as they are, all others in the byte alphabet."""
        b = self.tokens[token]
        return b.decode() if self.kind(token) in ("leading", "custom") else encode_py(b)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """id, bytes, kind, token."""
        rows = [(i, bytearray(b), self.kind(i), self.string(i)) for i, b in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "id int, bytes binary, kind string, token string")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        """rank, left, right, new_id."""
        rows = [(r, a, b, self.result(r)) for r, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left int, right int, new_id int")

    def metrics_table(self, spark: SparkSession) -> DataFrame:
        names = ("iteration", "best_frequency", "merges_applied", "distinct_pairs", "elapsed_iteration", "elapsed_total", "rss_kb")
        schema = "iteration int, best_frequency long, merges_applied long, distinct_pairs long, elapsed_iteration double, elapsed_total double, rss_kb long"
        return spark.createDataFrame([tuple(m.get(n) for n in names) for m in self.metrics], schema)

    def derived(self, size: int) -> Model:
        """The model with the first size tokens and the merges that made them."""
        base = self.config.base_size
        if not base <= size <= self.size:
            raise ValueError(f"a derived vocabulary has {base} to {self.size} tokens")
        merges = self.merges[: min(len(self.merges), size - base)]
        return Model(self.tokens[:size], merges, self.config.with_(vocab_size=size), self.metrics[: len(merges)], self.stop_reason)

    def to_json(self, pretty: bool = False) -> str:
        """A tokenizer.json as Hugging Face's libraries read it."""
        special = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
        added = [{"id": i, "content": t, **special} for t, i in sorted(self.special_ids.items(), key=lambda x: x[1])]
        splits = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        # A run that cuts by chance only can't be told to those who read the file.
        pattern = _SPACE_RUN.get(self.config.segmentation.mode) if self.config.segmentation.probability >= 1 else None
        if pattern:
            cut = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
            splits = {"type": "Sequence", "pretokenizers": [splits, cut]}
        strings = [self.string(i) for i in range(self.size)]
        out = {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": added,
            "normalizer": None,
            "pre_tokenizer": splits,
            "post_processor": None,
            "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
            "model": {
                "type": "BPE",
                "dropout": None,
                "unk_token": None,
                "continuing_subword_prefix": None,
                "end_of_word_suffix": None,
                "fuse_unk": False,
                "byte_fallback": True,
                "ignore_merges": False,
                "vocab": {s: i for i, s in enumerate(strings)},
                "merges": [[strings[a], strings[b]] for a, b in self.merges],
            },
        }
        return json.dumps(out, ensure_ascii=False, indent=2 if pretty else None)

    def save(self, path: str, pretty: bool = False) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json(pretty))

    def save_family(self, path: str, sizes: list[int], template: str | None = None, pretty: bool = False) -> list[str]:
        """Writes derived models, one a size; template names them with {size}, beside path if it is relative."""
        stem, ext = os.path.splitext(path)
        out = []
        for size in sorted(set(sizes)):
            if template is None:
                to = f"{stem}-{size}{ext}"
            else:
                to = template.replace("{size}", str(size))
                to = to if os.path.isabs(to) else os.path.join(os.path.dirname(path), to)
            self.derived(size).save(to, pretty)
            out.append(to)
        return out


def _segmentation(pre: dict | None) -> Segmentation:
    """The cutting that a file's pre-tokenizer names; none if it names none that is known here."""
    parts = (pre or {}).get("pretokenizers", [pre] if pre else [])
    patterns = [p.get("pattern", {}).get("Regex") for p in parts if p.get("type") == "Split"]
    return Segmentation(next((mode for mode, pattern in _SPACE_RUN.items() if pattern in patterns), "none"))


def load(path: str, legacy: str = "auto") -> Model:
    """A model from a tokenizer.json. legacy - auto, plain or escaped - tells how files without a byte-level decoder write bytes."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab: dict[str, int] = data["model"]["vocab"]
    added = {t["content"]: t["id"] for t in data.get("added_tokens", []) if t.get("special")}
    if not added:
        raise ValueError("the file names no special tokens")
    singles = tuple(sorted({*added, *(g for g in layout.REASONING if g in vocab)}, key=lambda t: (vocab.get(t, added.get(t)), t)))
    overrides = legacy_overrides(singles)
    decoder = (data.get("decoder") or {}).get("type")
    if decoder == "ByteLevel":
        encoding, overrides = GPT2, {}
    elif legacy == "escaped" or (legacy == "auto" and any(c in vocab for c in overrides.values())):
        encoding = LEGACY if overrides else PLAIN
    elif legacy in ("auto", "plain"):
        encoding, overrides = PLAIN, {}
    else:
        raise ValueError("legacy is auto, plain or escaped")
    strings = vocab | {t: i for t, i in added.items() if t not in vocab}
    tokens: list[bytes] = [b""] * (max(strings.values()) + 1)
    for t, i in strings.items():
        b = None if t in added else decode_py(t, encoding, overrides)
        tokens[i] = t.encode() if b is None else b
    pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    merges = [(vocab[a], vocab[b]) for a, b in pairs]
    results = [vocab[a + b] for a, b in pairs]
    reasoning = all(layout.FIRST_TRAILING + i < len(tokens) and tokens[layout.FIRST_TRAILING + i] == g.encode() for i, g in enumerate(layout.REASONING))
    custom = tuple(t for t in sorted(added, key=added.get) if t not in layout.LEADING)
    config = TrainerConfig(vocab_size=max(len(tokens), layout.FIRST_TRAILING + 49 * reasoning + len(custom)), custom_specials=custom, reasoning=reasoning, segmentation=_segmentation(data.get("pre_tokenizer")))
    return Model(tokens, merges, config, special_ids=added, encoding=encoding, overrides=overrides, results=results)


def info(path: str) -> dict:
    """What a tokenizer.json holds, and whether the reasoning glyphs stand where they should."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab = data["model"]["vocab"]
    added = [t for t in data.get("added_tokens", []) if t.get("special")]
    byte_level = (data.get("decoder") or {}).get("type") == "ByteLevel"
    by_id = {i: t for t, i in vocab.items()}
    shown, wrong = [], []
    for i, glyph in enumerate(layout.REASONING):
        token = by_id.get(layout.FIRST_TRAILING + i)
        b = None
        if token is not None:
            b = glyph.encode() if token == glyph else decode_py(token, GPT2 if byte_level else LEGACY)
        if token is None:
            label = "(missing)"
        elif b is None:
            label = f"(undecodable, {len(token)} chars)"
        else:
            try:
                label = b.decode()
            except UnicodeDecodeError:
                label = f"(non-utf8, {len(b)} bytes)"
        shown.append(label)
        if b != glyph.encode():
            wrong.append({"id": layout.FIRST_TRAILING + i, "expected": glyph, "actual": None if token is None else label})
    return {
        "path": path,
        "model_type": data["model"].get("type"),
        "base_vocab_size": max(0, len(vocab) - len(added)),
        "special_vocab_size": len(added),
        "total_vocab_size": len(vocab),
        "merges": len(data["model"]["merges"]),
        "byte_fallback": bool(data["model"].get("byte_fallback")),
        "special_tokens": [t["content"] for t in added],
        "special_token_ids": {t["content"]: t.get("id") for t in added},
        "reasoning_tokens": {"offset": layout.FIRST_TRAILING, "count": len(layout.REASONING), "matches": not wrong, "tokens": shown, "mismatches": wrong},
    }


_PRINTABLE = r"[\x00-\x08\x0E-\x1F\x7F]"
_SHARES = {
    "share_whitespace_only": r"\A[\t\n\x0B\f\r ]+\z",
    "share_leading_whitespace": r"\A[\t\n\x0B\f\r ]",
    "share_trailing_whitespace": r"[\t\n\x0B\f\r ]\z",
    "share_leading_whitespace_nonpure": r"(?s)\A[\t\n\x0B\f\r ].*[^\t\n\x0B\f\r ]",
    "share_trailing_whitespace_nonpure": r"(?s)[^\t\n\x0B\f\r ].*[\t\n\x0B\f\r ]\z",
    "share_internal_whitespace": r"(?s)\A(?=.*[\t\n\x0B\f\r ]).*[^\t\n\x0B\f\r ]",
    "share_newline": r"\n",
    "share_tab": r"\t",
    "share_digit": "[0-9]",
    "share_upper": "[A-Z]",
    "share_alpha": "[A-Za-z]",
    "share_non_ascii": r"[\x80-\xFF]",
    "share_non_printable": _PRINTABLE,
    "share_punct": r"[!-/:-@\[-`{-~]",
}


def vocab_stats(tokens: DataFrame, column: str = "bytes") -> DataFrame:
    """One row of length and content statistics of a table of tokens."""
    t = tokens.select(F.decode(column, "ISO-8859-1").alias("t"), F.octet_length(column).alias("n"))
    n = F.col("n")

    def share(c) -> object:  # noqa: ANN001
        return F.avg(c.cast("double"))

    spaces = F.length("t") - F.length(F.regexp_replace("t", r"[\t\n\x0B\f\r ]+", ""))
    blank = F.col("t").rlike(_SHARES["share_whitespace_only"])
    return t.agg(
        F.count("*").alias("token_count"),
        F.avg(n).alias("avg_len"),
        F.median(n).alias("median_len"),
        F.percentile(n, 0.95).alias("p95_len"),
        F.max(n).alias("max_len"),
        share(n >= 16).alias("share_len_ge16"),
        share(n >= 32).alias("share_len_ge32"),
        share(n == 1).alias("share_len_eq1"),
        *(share(F.col("t").rlike(p)).alias(name) for name, p in _SHARES.items()),
        F.coalesce(F.sum(spaces) / F.sum(n), F.lit(0.0)).alias("whitespace_byte_ratio"),
        F.coalesce(F.avg(F.when(blank, n)), F.lit(0.0)).alias("whitespace_only_avg_len"),
    )


def merge_overlap(a: Model, b: Model, k: int = 100) -> dict[str, int]:
    """Merges that two models share, over all, over the first k and over the last k; merges are pairs of bytes."""
    x, y = ([(m.tokens[p], m.tokens[q]) for p, q in m.merges] for m in (a, b))
    return {"all": len({*x} & {*y}), "top": len({*x[:k]} & {*y[:k]}), "bottom": len({*x[-k:]} & {*y[-k:]})}


def token_lengths(model: Model) -> dict[str, float]:
    """Average length of the tokens, and the share of those of 8 bytes or more."""
    n = [len(t) for t in model.tokens]
    return {"avg_len": statistics.fmean(n), "share_ge8": sum(x >= 8 for x in n) / len(n)}
