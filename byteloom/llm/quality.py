"""Quality rules as a short-circuit cascade.

Each rule accepts or rejects texts. On a small sample every rule's cost (seconds) and selectivity (share rejected) are
measured; the rules then run in the order of rejections per cost, and a document that one rejects is given to none after
it. A document stays if all rules accept it, so the order, and the sample with it, moves the time taken and never the
result. Rules count characters and words of whole texts in numpy, a batch at a time: the same counts by regular
expressions in Catalyst took about ten times the CPU.

The sample has about ``SAMPLE_ROWS`` texts, from the heads of up to ``SAMPLE_PARTITIONS`` partitions spread over the table, so
that it costs the same at any size and a table sorted by source gives texts of all of them.

Defined cases. A null or empty text, or one of white space only, is rejected. Words are split at ASCII white space and
NUL. A text on a rule's limit is accepted. Very long texts are judged whole; as new words get rarer with length, the rule on
distinct words asks for a share (35 %) of up to ``SHARE_WORDS`` words, and beyond for a number whose square grows as the words
do, which is the same at that point and no jump. Rules of equal rejections per cost run the cheaper one first. Repeated rows are
judged alike and all kept or all rejected. An empty table has no rows. Null ids and further columns have no part in it,
whatever their names, and are kept.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm import common, wordhash

#: Rows of the sample on which costs and selectivities are estimated, and partitions that they come from, at most.
SAMPLE_ROWS, SAMPLE_PARTITIONS = 1000, 16
#: Words of a text up to which a share of them has to be distinct.
SHARE_WORDS = 10_000
LETTER, NUMBER, UPPER, SPACE, ODD = 1, 2, 4, 8, 16


@cache
def classes() -> np.ndarray:
    """The classes of every code point, as bits."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER * (kind[0] == "L") | NUMBER * (kind[0] == "N") | UPPER * (kind == "Lu")
    space = [0, 9, 10, 11, 12, 13, 32]
    out[space] = SPACE
    plain = out != 0
    plain[[ord(c) for c in ".,;:!?'\"()-"]] = True
    out[~plain] |= ODD
    return out


class Texts:
    """A batch of texts, and counts by text that are made when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column

    @cached_property
    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        return common.flat(self.column)

    @cached_property
    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The classes of all characters, and where each text begins."""
        data, rows = self.bytes
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return classes()[points], heads[rows[0]]

    def count(self, kind: int, none: int = 0) -> np.ndarray:
        """Characters of each text that have a bit of kind and none of none; the NUL that ends a text is white space."""
        kinds, start = self.kinds
        hit = (kinds & kind) != 0
        if none:
            hit &= (kinds & none) == 0
        return np.add.reduceat(hit, start, dtype=np.int64)

    @cached_property
    def solid(self) -> np.ndarray:
        kinds, start = self.kinds
        return np.add.reduceat((kinds & SPACE) == 0, start, dtype=np.int64)

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all words, the row of each, and the number of words of each text."""
        data, rows = self.bytes
        start, _, h = wordhash.words(data, wordhash.SPACE)
        n = np.diff(wordhash.by_row(start, rows))
        return h, np.repeat(np.arange(len(n)), n), n

    @cached_property
    def distinct_words(self) -> np.ndarray:
        h, row, n = self.words
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        return np.bincount(row[new], minlength=len(n))

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines that aren't blank, and distinct ones, of each text."""
        split = [[x for x in t.split("\n") if x.strip(" \t\r\x0b\f\0")] for t in self.column.fill_null("").to_pylist()]
        return np.array([len(x) for x in split]), np.array([len(set(x)) for x in split])


@dataclass(frozen=True)
class Rule:
    """accept(texts) has True for each text that the rule accepts; sql is the same condition on a column t in DuckDB."""

    name: str
    accept: Callable[[Texts], np.ndarray]
    sql: str


def _odd(t: Texts) -> np.ndarray:
    return t.count(ODD) * 25 <= t.solid


def _upper(t: Texts) -> np.ndarray:
    return t.count(UPPER) * 5 <= t.solid * 2


def _letters(t: Texts) -> np.ndarray:
    return t.count(LETTER) * 10 >= t.solid * 3


def _word_length(t: Texts) -> np.ndarray:
    n = t.words[2]
    return (t.solid >= n * 2) & (t.solid <= n * 15)


def _distinct_words(t: Texts) -> np.ndarray:
    n, d = t.words[2], t.distinct_words
    return np.where(n <= SHARE_WORDS, d * 100 >= n * 35, d * d >= n * 1225)


def _repeated_lines(t: Texts) -> np.ndarray:
    n, d = t.lines
    return d * 2 >= n


def _stuttering(t: Texts) -> np.ndarray:
    h, row, n = t.words
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][same], minlength=len(n)) * 10 <= n * 3


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(13) || chr(12)"
_SQL_W = rf"string_split_regex(trim(t, {_WS}), '[ \t\n\x0b\r\f]+')"
_SQL_L = "list_filter(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(13) || chr(12)) <> '')"
_SQL_NS = r"length(regexp_replace(t, '[ \t\n\x0b\r\f]', '', 'g'))"
_SQL_ODD = r"""[^\p{L}\p{N} \t\n\x0b\r\f.,;:!?''"()\-]"""

RULES = (
    Rule("symbols", _odd, f"(length(t) - length(regexp_replace(t, '{_SQL_ODD}', '', 'g'))) * 25 <= {_SQL_NS}"),
    Rule("upper_case", _upper, rf"(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g'))) * 5 <= {_SQL_NS} * 2"),
    Rule("letters", _letters, rf"(length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g'))) * 10 >= {_SQL_NS} * 3"),
    Rule("word_length", _word_length, f"{_SQL_NS} between len({_SQL_W}) * 2 and len({_SQL_W}) * 15"),
    Rule(
        "distinct_words",
        _distinct_words,
        f"case when len({_SQL_W}) <= {SHARE_WORDS} then list_unique({_SQL_W}) * 100 >= len({_SQL_W}) * 35 else list_unique({_SQL_W})::hugeint * list_unique({_SQL_W}) >= len({_SQL_W})::hugeint * 1225 end",
    ),
    Rule("repeated_lines", _repeated_lines, f"list_unique({_SQL_L}) * 2 >= len({_SQL_L})"),
    Rule("stuttering", _stuttering, f"len(list_filter(list_zip({_SQL_W}[:-2], {_SQL_W}[2:]), lambda x: x[1] = x[2])) * 10 <= len({_SQL_W}) * 3"),
)


def accepted_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The condition on t, in DuckDB's SQL, that all rules accept it."""
    return " and ".join([f"trim(t, {_WS}) <> ''", *(f"({r.sql})" for r in rules)])


def sample(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, partitions: int = SAMPLE_PARTITIONS) -> list[str]:
    """About so many texts, from the first rows of partitions that are spread evenly over docs. No other partition is read."""
    # The low 33 bits of the number count the rows of a partition; later rows aren't sent to Python.
    heads = docs.select(docs[text_col].alias("t"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("i"))
    rdd = heads.where((F.col("i") < rows) & (F.length("t") > 0)).select("t").rdd
    total = rdd.getNumPartitions()
    chosen = sorted({i * total // partitions for i in range(partitions)}) if total > partitions else list(range(total))
    if not chosen:
        return []
    each = -(-rows // len(chosen))
    return docs.sparkSession.sparkContext.runJob(rdd, lambda found: [r.t for r in islice(found, each)], chosen)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Each rule with the seconds and the share rejected that a sample of the documents shows."""
    texts = pa.array(sample(docs, text_col, rows), pa.large_string())
    if not len(texts):
        return [(rule, 1e-6, 0.0) for rule in rules]
    classes()
    out = []
    for rule in rules:
        fresh = Texts(texts)
        began = time.perf_counter()
        rejected = int((~rule.accept(fresh)).sum())
        out.append((rule, max(1e-6, time.perf_counter() - began), rejected / len(texts)))
    return out


def ordered(found: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejections per cost, most first; rules that reject nothing come last, the cheapest first."""
    return [r for r, _, _ in sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))]


def accepted(column: pa.Array, rules: list[Rule]) -> np.ndarray:
    """True for each text that all rules accept; a rule sees only what those before it accepted."""
    texts = Texts(column)
    left = np.flatnonzero(texts.words[2] > 0) if len(column) else np.zeros(0, int)
    if len(left) < len(column):
        texts = Texts(column.take(pa.array(left)))
    for rule in rules:
        if not len(left):
            break
        ok = rule.accept(texts)
        if not ok.all():
            left = left[ok]
            texts = Texts(texts.column.filter(pa.array(ok)))
    out = np.zeros(len(column), bool)
    out[left] = True
    return out


def cascade(t: Column, rules: list[Rule]) -> Column:
    """True for texts that all rules accept."""

    def judge(t: pa.Array) -> pa.Array:
        out = [accepted(b.column(0), rules) for b in common.pieces([pa.RecordBatch.from_arrays([t], ["t"])], 0)]
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool), pa.bool_())

    return F.arrow_udf(judge, "boolean")(t)


def filter_documents(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that all rules accept, with the columns of docs."""
    return docs.where(cascade(docs[text_col], ordered(measured(docs, rules, text_col, sample_rows))))
