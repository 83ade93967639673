"""Registered queries of the engine over the driver's tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.config import Segmentation, TrainerConfig
from byteloom.functions import bytes as fb
from byteloom.model import Model, info, load, merge_overlap, token_lengths
from byteloom.model import vocab_stats as stats_of_tokens
from byteloom.operators import codec, kernel, pairs, segment, stats
from byteloom.plans import chunked, sql, train
from byteloom.sources import extract_field, token_lists
from byteloom.sources.files import chunked as in_chunks

ASCII = Segmentation("ascii")
CHUNK = 1024
#: Least count of a pair that a source offers for combining.
LEAST = 50


def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", "source", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _hex(word: str = "word") -> object:
    return F.hex(F.encode(word, "ISO-8859-1"))


def _words(docs: DataFrame, config: Segmentation) -> DataFrame:
    return segment.words(docs, config)


def segment_ascii_counts(spark: SparkSession, d: str) -> DataFrame:
    return _words(_documents(spark, d), ASCII).select(_hex().alias("word"), "weight")


def segment_unicode_counts(spark: SparkSession, d: str) -> DataFrame:
    return _words(_documents(spark, d), Segmentation("unicode")).select(_hex().alias("word"), "weight")


def segment_null_counts(spark: SparkSession, d: str) -> DataFrame:
    """Line feeds stand in for the NULs that texts lack."""
    docs = _documents(spark, d).withColumn("content", fb.from_latin1(F.replace(fb.latin1(F.col("content")), F.lit("\n"), F.lit("\0"))))
    return _words(docs, Segmentation("null")).select(_hex().alias("word"), "weight")


def segment_glued_counts(spark: SparkSession, d: str) -> DataFrame:
    """Half of the white-space runs, drawn by a hash, glue the words on both sides."""
    return segment.words(_documents(spark, d), Segmentation("ascii", 0.5, 7), sequence="doc_id").select(_hex().alias("word"), "weight")


def segment_null_glued_counts(spark: SparkSession, d: str) -> DataFrame:
    """Line feeds stand in for NULs; at each edge of a run a hash draws whether it cuts."""
    docs = _documents(spark, d).withColumn("content", fb.from_latin1(F.replace(fb.latin1(F.col("content")), F.lit("\n"), F.lit("\0"))))
    return segment.words(docs, Segmentation("null", 0.5, 7), sequence="doc_id").select(_hex().alias("word"), "weight")


def segment_none_counts(spark: SparkSession, d: str) -> DataFrame:
    """Whole sequences; the empty ones are dropped."""
    out = segment.words(_documents(spark, d), Segmentation("ascii", 0.0))
    return out.select(F.md5(F.encode("word", "ISO-8859-1")).alias("digest"), F.length("word").alias("n_bytes"), "weight")


def segments_listed(spark: SparkSession, d: str) -> DataFrame:
    """Every segment with its place, and whether it is a delimiter."""
    out = segment.segments(_documents(spark, d), ASCII, sequence="doc_id")
    return out.select(F.col("seq").alias("doc_id"), "pos", F.hex("seg").alias("seg"), "is_delim")


def byte_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.byte_histogram(_documents(spark, d))


def byte_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return pairs.byte_pair_counts(_documents(spark, d)).select(F.hex("pair").alias("pair"), "n")


def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The report of the 20 most frequent pairs within words."""
    return pairs.top_pairs(pairs.pair_counts(_words(_documents(spark, d), ASCII)), 20).select(_hex("pair").alias("pair"), "n")


def merge_step(spark: SparkSession, d: str) -> DataFrame:
    """Pairs after the merge of t and h to one token, U+0100."""
    words = _words(_documents(spark, d), ASCII).withColumn("word", pairs.rewritten(F.col("word"), [("th", "Ā")]))
    return pairs.pair_counts(words).select(F.hex(F.encode("pair", "UTF-16BE")).alias("pair"), "n")


def doc_entropy(spark: SparkSession, d: str) -> DataFrame:
    return stats.with_entropy(_documents(spark, d)).select("doc_id", F.round("entropy", 9).alias("entropy"))


def entropy_filtered_docs(spark: SparkSession, d: str) -> DataFrame:
    return stats.entropy_window(_documents(spark, d), 4.1, 4.3).select("doc_id", F.octet_length("content").alias("n_bytes"))


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = in_chunks(_documents(spark, d), CHUNK)
    return out.select("doc_id", "chunk_index", F.octet_length("content").alias("n_bytes"), F.md5(F.hex("content")).alias("digest"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    out = in_chunks(_documents(spark, d), CHUNK)
    return out.select((F.col("doc_id") * (1 << 20) + F.col("chunk_index")).alias("index"), "content")


def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    return stats.deduplicated(_chunks(spark, d), "index").select("index", "first_index")


def chunk_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = stats.with_entropy(_documents(spark, d).where(F.octet_length("content") > 0))
    out = stats.chunk_weights(docs.select("doc_id", F.octet_length("content").alias("byte_len"), "entropy"))
    return out.select("doc_id", F.round("weight", 9).alias("weight"))


def json_field_extract(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


def json_text_field(spark: SparkSession, d: str) -> DataFrame:
    """A string at a path of JSON lines, made of the documents; a line without it would be an error."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    line = F.to_json(F.struct(F.struct(F.col("text").alias("b")).alias("a"), "lang"))
    return docs.select("doc_id", F.md5(F.encode(extract_field(line, ["a", "b"]), "UTF-8")).alias("digest"))


def token_list_sums(spark: SparkSession, d: str) -> DataFrame:
    """Ids written as text, with white space of any kind between."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = token_lists(F.concat(F.lit(" "), F.col("doc_id"), F.lit("\t\n"), F.coalesce("n_chars", F.lit(0)), F.lit("\n")))
    return docs.select("doc_id", F.size(ids).alias("n"), F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """index, left, right, best_frequency: the frequent pairs of each source's words."""
    words = _documents(spark, d).select("source", F.explode(segment.runs(F.col("content"), "ascii")).alias("word")).groupBy("source", "word").agg(F.count("*").alias("weight"))
    found = words.where(F.length("word") > 1).select("source", "weight", F.explode(pairs.adjacent(F.col("word"))).alias("pair"))
    found = found.groupBy("source", "pair").agg(F.sum("weight").alias("best_frequency")).where(F.col("best_frequency") >= LEAST)
    b = F.encode("pair", "ISO-8859-1")
    return found.select(F.col("source").alias("index"), F.substring(b, 1, 1).alias("left"), F.substring(b, 2, 1).alias("right"), "best_frequency")


def _combined(spark: SparkSession, d: str, mode: str) -> DataFrame:
    offers, weights = _offers(spark, d), None
    if mode == "entropy":
        whole = _documents(spark, d).groupBy("source").agg(F.sum(F.octet_length("content")).alias("byte_len"), F.avg(stats.entropy_of(F.col("content"))).alias("entropy"))
        weights = stats.chunk_weights(whole).select(F.col("source").alias("index"), "weight")
    # At most all pairs of two bytes, whose places in the order are numbered.
    out = chunked.ordered(chunked.combined_merges(offers, weights), mode, 20).coalesce(1)
    out = out.withColumn("place", (F.monotonically_increasing_id() + 1).cast("long"))
    return out.select("place", F.hex("left").alias("left"), F.hex("right").alias("right"), "total", "support", F.round("weighted", 4).alias("weighted"))


def combine_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d, "frequency")


def combine_support(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d, "support")


def combine_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _combined(spark, d, "entropy")


def vocab_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the distinct segments as if they were a vocabulary."""
    out = stats_of_tokens(_words(_documents(spark, d), ASCII).select(F.encode("word", "ISO-8859-1").alias("bytes")))
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def token_predicates(spark: SparkSession, d: str) -> DataFrame:
    b = F.encode("word", "ISO-8859-1")
    flags = {"is_space": fb.is_space(b), "has_letter": fb.has_letter(b), "starts_with_space": fb.starts_with_space(b), "ends_with_space": fb.ends_with_space(b)}
    return _words(_documents(spark, d), Segmentation("null")).select(_hex().alias("word"), *(c.alias(n) for n, c in flags.items()))


def gpt2_strings(spark: SparkSession, d: str) -> DataFrame:
    out = fb.encode_bytes(F.col("content"))
    back = fb.decode_string(out) == F.col("content")
    return _documents(spark, d).select("doc_id", F.md5(F.encode(out, "UTF-8")).alias("digest"), back.alias("same"))


def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents and benchmark items together."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.encode("text", "UTF-8").alias("content"))
    return _words(_documents(spark, d).select("content").unionByName(items), ASCII).select(_hex().alias("word"), "weight")


def frequent_words(spark: SparkSession, d: str) -> DataFrame:
    return _words(_documents(spark, d), ASCII).where(F.col("weight") >= 4).select(_hex().alias("word"), "weight")


_CONFIG = TrainerConfig(vocab_size=400, min_frequency=4, segmentation=ASCII)


_RULES = TrainerConfig(vocab_size=400, min_frequency=4, require_letter=True, forbid_leading_space=True)
_CHUNKED = TrainerConfig(vocab_size=328, min_frequency=4, segmentation=ASCII)


def _digest(tokens: str = "tokens") -> object:
    return F.md5(F.array_join(tokens, ","))


def _with_metrics(spark: SparkSession, model: Model) -> DataFrame:
    metrics = model.metrics_table(spark).select((F.col("iteration") - 1).alias("rank"), "best_frequency", "merges_applied")
    return model.merge_table(spark).join(metrics, "rank")


def train_merges(spark: SparkSession, d: str) -> DataFrame:
    return _with_metrics(spark, train.train(_documents(spark, d), _CONFIG))


def train_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return train.train(_documents(spark, d), _CONFIG).vocabulary(spark).select("id", F.hex("bytes").alias("bytes"), "kind", "token")


def train_padded_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Ten merges, and runs of white space that fill the vocabulary."""
    model = train.train(_documents(spark, d), _CONFIG.with_(max_iterations=10, vocab_size=340))
    return model.vocabulary(spark).select("id", F.hex("bytes").alias("bytes"), "kind", "token")


def train_whole_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Merges over uncut documents under the rules for white space."""
    return _with_metrics(spark, train.train(_documents(spark, d), _RULES))


def train_merges_spark(spark: SparkSession, d: str) -> DataFrame:
    """The merges of train_merges by the loop that stays on Spark."""
    return _with_metrics(spark, train.train(_documents(spark, d), _CONFIG, engine="spark"))


def train_plateau(spark: SparkSession, d: str) -> DataFrame:
    """Training that ends with the third pair in a row that is rarer than a fifth of the first."""
    model = train.train(_documents(spark, d), _CONFIG.with_(plateau=True, plateau_floor=1, plateau_patience=3, plateau_divisor=5))
    return _with_metrics(spark, model).withColumn("stop_reason", F.lit(model.stop_reason))


def derived_merges(spark: SparkSession, d: str) -> DataFrame:
    """A smaller model of a trained one."""
    return train.train(_documents(spark, d), _CONFIG).derived(350).merge_table(spark)


def saved_and_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary that a tokenizer.json gives back."""
    model = train.train(_documents(spark, d), _CONFIG.with_(vocab_size=340))
    with tempfile.TemporaryDirectory() as folder:
        model.save(f"{folder}/t.json")
        back = load(f"{folder}/t.json")
    return back.vocabulary(spark).select("id", F.hex("bytes").alias("bytes"), F.lit(back.config.segmentation.mode).alias("mode"))


def model_info(spark: SparkSession, d: str) -> DataFrame:
    """What the description of a tokenizer.json counts."""
    model = train.train(_documents(spark, d), _CONFIG.with_(vocab_size=340))
    with tempfile.TemporaryDirectory() as folder:
        model.save(f"{folder}/t.json")
        found = info(f"{folder}/t.json")
    row = (found["base_vocab_size"], found["special_vocab_size"], found["total_vocab_size"], found["merges"], found["reasoning_tokens"]["count"], len(found["reasoning_tokens"]["mismatches"]))
    return spark.createDataFrame([row], "base int, special int, total int, merges int, glyphs int, mismatches int")


def models_compared(spark: SparkSession, d: str) -> DataFrame:
    """Merges that the models of documents and of benchmark items share, and lengths of the former's tokens."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    config = _CONFIG.with_(vocab_size=344)
    one, two = train.train(_documents(spark, d), config), train.train(items, config)
    row = merge_overlap(one, two, 16) | token_lengths(one)
    return spark.createDataFrame([tuple(row.values())], "all int, top int, bottom int, avg_len double, share_ge8 double").select("all", "top", "bottom", F.round("avg_len", 9).alias("avg_len"), F.round("share_ge8", 9).alias("share_ge8"))


def _doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into chunks of 32 KiB, numbered."""
    out = in_chunks(_documents(spark, d), 32 << 10)
    return out.select((F.col("doc_id") * (1 << 20) + F.col("chunk_index")).alias("index"), "content")


def _chunk_merges(spark: SparkSession, d: str, mode: str) -> DataFrame:
    result = chunked.train_chunks(_doc_chunks(spark, d), _CHUNKED, mode)
    result.unpersist()
    model = result.model
    t = model.tokens
    rows = [(r, t[a].hex().upper(), t[b].hex().upper()) for r, (a, b) in enumerate(model.merges)]
    return spark.createDataFrame(rows, "rank int, left string, right string")


def chunk_train(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary for each chunk, combined by support."""
    return _chunk_merges(spark, d, "support")


def chunk_train_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_merges(spark, d, "frequency")


def chunk_train_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_merges(spark, d, "entropy")


def chunk_train_first(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_merges(spark, d, "first")


def chunk_train_report(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a run that skips chunks of low and of high entropy, for both ways to treat repeats."""
    rows = []
    for how in chunked.DUPLICATES:
        result = chunked.train_chunks(_doc_chunks(spark, d), _CHUNKED.with_(vocab_size=316), "frequency", how, low=4.1, high=4.3)
        result.unpersist()
        r = result.report
        rows.append((how, *(r[k] for k in ("processed_chunks", "total_chunks", "unique_chunks", "skipped_low_entropy", "skipped_high_entropy", "duplicates_skipped", "duplicates_reused"))))
    return spark.createDataFrame(rows, "duplicates string, processed long, total long, uniques long, low long, high long, skipped long, reused long")


def encode_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    model = train.train(docs, _CONFIG.with_(vocab_size=376))
    return codec.encode(docs, model).select("doc_id", F.size("tokens").alias("n_tokens"), _digest().alias("digest"))


def encode_by_heap(spark: SparkSession, d: str) -> DataFrame:
    """Encoding as it is done with more merges than are folded into one expression."""
    docs = _documents(spark, d)
    model = train.train(docs, _CONFIG)
    out = docs.withColumn("tokens", codec.heaped(F.col("content"), model))
    return out.select("doc_id", F.size("tokens").alias("n_tokens"), _digest().alias("digest"))


def decode_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    model = train.train(docs, _CONFIG.with_(vocab_size=376))
    out = codec.decode(codec.encode(docs, model), model, out="decoded")
    return out.select("doc_id", F.md5("decoded").alias("digest"))


def decode_without_specials(spark: SparkSession, d: str) -> DataFrame:
    """Special literals around the texts become ids that decoding skips; the vocabulary is a large one."""
    docs = _documents(spark, d).withColumn("content", F.concat(F.lit(b"<|start|>"), F.col("content"), F.lit(b"<|end|>")))
    plain = kernel.Trained(kernel.Decider(_CONFIG.with_(vocab_size=3000)).out.tokens)
    model = train.finished(plain, _CONFIG.with_(vocab_size=3000))
    out = codec.decode(codec.encode(docs, model), model, out="decoded", skip_special=True)
    return out.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5("decoded").alias("digest"))


def sample_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the first 101 bytes, read as Latin-1 where they end within a character, with and without merges."""
    docs = _documents(spark, d)
    model = train.train(docs, _CONFIG.with_(vocab_size=376))
    return codec.compared(docs, {"merged": model, "plain": model.derived(312)}, first_bytes=101).select("doc_id", "merged", "plain")


def legacy_strings(spark: SparkSession, d: str) -> DataFrame:
    """Bytes as legacy files write them, with two of them moved; and what strings of other characters decode to."""
    text = fb.encode_bytes(F.col("content"), fb.LEGACY)
    back = fb.decode_string(text, fb.LEGACY) == F.col("content")
    wrong = fb.try_decode_string(F.concat(text, F.lit("\u4e2d")), fb.LEGACY)
    return _documents(spark, d).select("doc_id", F.md5(F.encode(text, "UTF-8")).alias("digest"), back.alias("same"), wrong.isNull().alias("refused"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (
        segment_ascii_counts, segment_unicode_counts, segment_null_counts, segment_none_counts, segment_glued_counts, segment_null_glued_counts, segments_listed,
        byte_histogram, byte_pair_counts, top_pairs, merge_step, doc_entropy, entropy_filtered_docs, fixed_chunks, chunk_dedup, chunk_weights, json_field_extract,
        json_text_field, token_list_sums, combine_frequency, combine_support, combine_entropy, vocab_stats, token_predicates, gpt2_strings, legacy_strings, corpus_union,
        frequent_words, train_merges, train_vocabulary, train_padded_vocabulary, train_whole_sequences, train_merges_spark, train_plateau, derived_merges, saved_and_loaded,
        model_info, models_compared, chunk_train, chunk_train_frequency, chunk_train_entropy, chunk_train_first, chunk_train_report, encode_documents, encode_by_heap,
        decode_roundtrip, decode_without_specials, sample_token_counts,
    )
    return {f.__name__: f for f in all_}


_WS = r"\t-\r "
_UWS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_T = "coalesce(text, '')"


def _split(white: str, text: str = _T) -> str:
    return f"unnest(regexp_extract_all({text}, '[{white}]+|[^{white}]+'))"


_SEGMENTS = f"select w, count(*) as weight from (select {_split(_WS)} as w from documents) group by w"
_BYTES = "regexp_extract_all(hex(encode({})), '..')"
_HIST = f"select doc_id, b, count(*) as c from (select doc_id, unnest({_BYTES.format(_T)}) as b from documents) group by doc_id, b"
_ENTROPY = f"select doc_id, greatest(0.0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) as entropy, sum(c) as n_bytes from ({_HIST}) group by doc_id"
_PAIRS = "unnest(list_transform(list_zip(bs[:-2], bs[2:]), lambda x: x[1] || x[2]))"
_CHUNKS = f"select doc_id, i, substr(h, {2 * CHUNK} * i::bigint + 1, {2 * CHUNK}) as c from (select doc_id, h, unnest(range((length(h) + {2 * CHUNK} - 1) // {2 * CHUNK})) as i from (select doc_id, hex(encode({_T})) as h from documents))"
_WEIGHTS = "greatest(0.1, least(1.0, entropy / 8)) * greatest(0.5, least(2.0, sqrt(byte_len / avg(byte_len) over ())))"
_OFFERS = f"""
select source as index, substr(p, 1, 2) as l, substr(p, 3, 2) as r, sum(weight) as n from (
  select source, weight, {_PAIRS} as p from (
    select source, {_BYTES.format("w")} as bs, count(*) as weight from (select source, {_split(_WS)} as w from documents) group by source, w))
group by all having sum(weight) >= {LEAST}
"""


def _combined_sql(order: str, weights: str | None = None, having: str = "") -> str:
    join = f"left join ({weights}) w on w.index = o.index" if weights else ""
    weight = "w.weight" if weights else "1.0"
    return f"""
    select row_number() over (order by {order}, length(l) + length(r), l, r) as place, l as "left", r as "right", total, support, round(weighted, 4) as weighted from (
      select l, r, sum(n)::bigint as total, count(*) as support, sum(n * {weight})::double as weighted from ({_OFFERS}) o {join} group by l, r {having})
    """


def _numbered(white: str) -> str:
    return f"select doc_id, i, len(ws) as n, ws[i] as w from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from (select doc_id, regexp_extract_all({_T}, '[{white}]+|[^{white}]+') as ws from documents))"


def _glued_sql(white: str, alone: str | None) -> str:
    """Counts of glued segments: a run of white space that doesn't stand alone glues its neighbours; or each edge draws."""
    draw = "('0x' || substr(md5('7:' || doc_id || ':' || (i - 1)), 1, 10))::bigint / 1099511627776.0 < 0.5"
    if alone is None:
        begins = "i = 1 or cut"
        word = f"array_to_string(list_transform({_BYTES.format('w')}, lambda x: case when x = '0A' then '00' else x end), '')"
    else:
        begins = "coalesce(alone or lag(alone) over (partition by doc_id order by i), true)"
        word = "hex(encode(w))"
    rows = f"select *, {draw} as cut, regexp_matches(w, '^[{white}]') as delim from ({_numbered(white)})"
    rows = f"select *, delim and ({alone or 'true'}) as alone from ({rows})"
    parts = f"select doc_id, i, w, sum(begins::int) over (partition by doc_id order by i) as part from (select *, {begins} as begins from ({rows}))"
    return f"select {word} as word, count(*) as weight from (select string_agg(w, '' order by i) as w from ({parts}) group by doc_id, part) group by w"


def _flag(pattern: str, of: str = "t") -> str:
    return f"regexp_matches({of}, '{pattern}')"


def oracle_sql() -> dict[str, str]:
    count = "select hex(encode(w)) as word, count(*) as weight from (select {} as w from {}) group by w"
    rate = "avg(({})::int::double)"
    shares = {
        "share_whitespace_only": rf"^[{_WS}]+\z",
        "share_leading_whitespace": rf"^[{_WS}]",
        "share_trailing_whitespace": rf"[{_WS}]\z",
        "share_leading_whitespace_nonpure": rf"(?s)^[{_WS}].*[^{_WS}]",
        "share_trailing_whitespace_nonpure": rf"(?s)[^{_WS}].*[{_WS}]\z",
        "share_internal_whitespace": rf"(?s)[{_WS}].*[^{_WS}]|[^{_WS}].*[{_WS}]",
        "share_newline": r"\n",
        "share_tab": r"\t",
        "share_digit": "[0-9]",
        "share_upper": "[A-Z]",
        "share_alpha": "[A-Za-z]",
        "share_non_ascii": r"[^\x00-\x7F]",
        "share_non_printable": r"[\x00-\x08\x0E-\x1F\x7F]",
        "share_punct": r"[!-/:-@\[-`{-~]",
    }
    source_weights = f"""
    select index, raw / sum(raw) over () as weight from (
      select source as index, {_WEIGHTS} as raw from (
        select source, avg(entropy) as entropy, sum(n_bytes) as byte_len from (
          select d.source, coalesce(e.entropy, 0.0) as entropy, coalesce(e.n_bytes, 0) as n_bytes from documents d left join ({_ENTROPY}) e using (doc_id)) group by source))
    """
    alphabet = fb.gpt2_alphabet().replace("'", "''")
    legacy = fb.alphabet(fb.LEGACY).replace("'", "''")
    return {
        "segment_ascii_counts": count.format(_split(_WS), "documents"),
        "segment_unicode_counts": count.format(_split(_UWS), "documents"),
        "segment_null_counts": f"select array_to_string(list_transform({_BYTES.format('w')}, lambda x: case when x = '0A' then '00' else x end), '') as word, count(*) as weight from (select {_split(chr(92) + 'n')} as w from documents) group by w",
        "byte_histogram": f"select byte, count(*) as n from (select unnest({_BYTES.format(_T)}) as byte from documents) group by byte",
        "byte_pair_counts": f"select pair, count(*) as n from (select {_PAIRS} as pair from (select {_BYTES.format(_T)} as bs from documents)) group by pair",
        "top_pairs": f"select pair, sum(weight)::bigint as n from (select weight, {_PAIRS} as pair from (select weight, {_BYTES.format('w')} as bs from ({_SEGMENTS}))) group by pair order by n desc, pair limit 20",
        "merge_step": f"""
            select pair, sum(weight)::bigint as n from (select weight, {_PAIRS} as pair from (
              select weight, string_split(trim(replace(array_to_string(list_transform({_BYTES.format("w")}, lambda x: '00' || x), ' ') || ' ', '0074 0068 ', '0100 ')), ' ') as bs from ({_SEGMENTS})))
            group by pair""",
        "doc_entropy": f"select d.doc_id, round(coalesce(e.entropy, 0.0), 9) as entropy from documents d left join ({_ENTROPY}) e using (doc_id)",
        "entropy_filtered_docs": f"select doc_id, n_bytes::int as n_bytes from ({_ENTROPY}) where entropy between 4.1 and 4.3",
        "fixed_chunks": f"select doc_id, i::int as chunk_index, (length(c) // 2)::int as n_bytes, md5(c) as digest from ({_CHUNKS})",
        "chunk_dedup": f"select doc_id * {1 << 20} + i as index, min(doc_id * {1 << 20} + i) over (partition by c) as first_index from ({_CHUNKS})",
        "chunk_weights": f"select doc_id, round(raw / sum(raw) over (), 9) as weight from (select doc_id, {_WEIGHTS} as raw from (select doc_id, entropy, n_bytes as byte_len from ({_ENTROPY})))",
        "json_field_extract": "select event_id, json_extract_string(props, '$.k') as k from events",
        "combine_frequency": _combined_sql("total desc, support desc"),
        "combine_support": _combined_sql("support desc, total desc"),
        "combine_entropy": _combined_sql("round(weighted, 6) desc, support desc, total desc", source_weights, "having count(*) >= 2"),
        "vocab_stats": f"""
            select count(*) as token_count, round(avg(n), 9) as avg_len, round(median(n)::double, 9) as median_len, round(quantile_cont(n, 0.95)::double, 9) as p95_len, max(n)::int as max_len,
              round({rate.format("n >= 16")}, 9) as share_len_ge16, round({rate.format("n >= 32")}, 9) as share_len_ge32, round({rate.format("n = 1")}, 9) as share_len_eq1,
              {", ".join(f"round({rate.format(_flag(p))}, 9) as {name}" for name, p in shares.items())},
              round(sum(length(t) - length(regexp_replace(t, '[{_WS}]', '', 'g'))) / sum(n), 9) as whitespace_byte_ratio,
              round(coalesce(avg(case when {_flag(shares["share_whitespace_only"])} then n end), 0.0), 9) as whitespace_only_avg_len
            from (select w as t, octet_length(encode(w)) as n from ({_SEGMENTS}))""",
        "token_predicates": f"""
            select distinct hex(encode(t)) as word, {_flag(rf"^[{_WS}]+" + chr(92) + "z")} as is_space, {_flag("[A-Za-z]")} as has_letter, {_flag(f"^[{_WS}]")} as starts_with_space, {_flag(f"[{_WS}]" + chr(92) + "z")} as ends_with_space
            from (select {_T} as t from documents) where t <> ''""",
        "gpt2_strings": f"select doc_id, md5(array_to_string(list_transform({_BYTES.format(_T)}, lambda x: substr('{alphabet}', ('0x' || x)::int + 1, 1)), '')) as digest, true as same from documents",
        "corpus_union": count.format(_split(_WS), "(select text from documents union all select text from benchmark)"),
        "frequent_words": count.format(_split(_WS), "documents") + " having count(*) >= 4",
        "segment_none_counts": f"select md5(t) as digest, octet_length(encode(t))::int as n_bytes, count(*) as weight from (select {_T} as t from documents) where t <> '' group by t",
        "segments_listed": f"select doc_id, (i - 1)::int as pos, hex(encode(w)) as seg, {_flag(rf'^[{_WS}]', 'w')} as is_delim from ({_numbered(_WS)})",
        "segment_glued_counts": _glued_sql(_WS, "i in (1, n) or cut"),
        "segment_null_glued_counts": _glued_sql(chr(92) + "n", None),
        "json_text_field": "select doc_id, md5(text) as digest from documents where text is not null",
        "token_list_sums": "select doc_id, 2 as n, doc_id + coalesce(n_chars, 0) as total from documents",
        "legacy_strings": f"select doc_id, md5(array_to_string(list_transform({_BYTES.format(_T)}, lambda x: substr('{legacy}', ('0x' || x)::int + 1, 1)), '')) as digest, true as same, true as refused from documents",
        "train_merges": sql.merges(_CONFIG, _SEGMENTS),
        "train_merges_spark": sql.merges(_CONFIG, _SEGMENTS),
        "train_whole_sequences": sql.merges(_RULES, f"select {_T} as w, count(*) as weight from documents group by text"),
        "train_plateau": sql.plateau(_CONFIG, _SEGMENTS, 3, 5),
        "train_vocabulary": sql.vocabulary(_CONFIG, _SEGMENTS),
        "train_padded_vocabulary": sql.vocabulary(_CONFIG.with_(vocab_size=340), _SEGMENTS, 10),
        "derived_merges": sql.merges(_CONFIG.with_(vocab_size=350), _SEGMENTS, metrics=False),
        "saved_and_loaded": f"select id, bytes, 'ascii' as mode from ({sql.vocabulary(_CONFIG.with_(vocab_size=340), _SEGMENTS)})",
        "model_info": "select 333::int as base, 7::int as special, 340::int as total, 28::int as merges, 49::int as glyphs, 0::int as mismatches",
        "models_compared": sql.overlap(_CONFIG.with_(vocab_size=344), _SEGMENTS, _SEGMENTS.replace("from documents", "from benchmark"), 16),
        "encode_documents": sql.encoded(_CONFIG.with_(vocab_size=376), _SEGMENTS, _T),
        "encode_by_heap": sql.encoded(_CONFIG, _SEGMENTS, _T),
        "decode_roundtrip": f"select doc_id, md5({_T}) as digest from documents",
        "decode_without_specials": f"select doc_id, (octet_length(encode({_T})) + 2)::int as n_tokens, md5({_T}) as digest from documents",
        "sample_token_counts": sql.sampled(_CONFIG.with_(vocab_size=376), _SEGMENTS, _T, 101),
        **{f"chunk_train{'_' * (mode != 'support')}{mode * (mode != 'support')}": sql.chunks(_CHUNKED, mode) for mode in chunked.MODES},
        "chunk_train_report": sql.chunk_report(4.1, 4.3),
    }
