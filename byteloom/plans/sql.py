"""Training, encoding and combining in DuckDB's SQL: what the registered queries are held against.

As in training on Spark a token is one character, so a word is a string and a merge a replacement. A step of training is
three tables: t, the pair that is merged; w, the words after it; s, the tokens' characters and bytes.
"""

from __future__ import annotations

from byteloom import layout
from byteloom.config import TrainerConfig
from byteloom.functions.bytes import gpt2_alphabet

_BYTES = "regexp_extract_all(hex(encode({})), '..')"
_CHARS = "array_to_string(list_transform(" + _BYTES + ", lambda x: chr(('0x' || x)::int)), '')"
_SPACE = "(09|0A|0B|0C|0D|20)"


def _char(config: TrainerConfig, rank: int) -> str:
    return layout.char_of(config.base_size + rank)


def _id(char: str) -> str:
    first = ord(layout.char_of(0))
    return f"(case when unicode({char}) >= {first} then unicode({char}) - {first} else unicode({char}) + {layout.FIRST_BYTE} end)::int"


def _rules(config: TrainerConfig, h: str) -> str:
    """The condition that a token's hex passes the rules for white space."""
    pure, has_letter = f"regexp_matches({h}, '^{_SPACE}+$')", f"regexp_matches({h}, '^(..)*(4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])')"
    mixed = [f"not regexp_matches({h}, '^(..)*{_SPACE}$')"]
    if config.forbid_leading_space:
        mixed.append(f"not regexp_matches({h}, '^{_SPACE}')")
    if config.require_letter:
        mixed.append(f"(not regexp_matches({h}, '^(..)*{_SPACE}') or {has_letter})")
    return f"({pure} or ({' and '.join(mixed)}))"


def _trained(config: TrainerConfig, words: str, steps: int, by: str = "", tag: str = "") -> list[str]:
    """Common tables of so many steps over words (w, weight), or over words of each value of a column named by."""
    key, using, part = (f"{by}, ", f"using ({by})", f"partition by {by} ") if by else ("", "", "")
    special = ", ".join(f"'{t.encode().hex().upper()}'" for t in (*layout.LEADING, *config.trailing))
    lengths = ", ".join(str(2 * n) for n in config.allowed_lengths)
    out = [f"w{tag}0 as materialized (select {key}{_CHARS.format('w')} as w, weight from ({words}) where octet_length(encode(w)) > 1)"]
    tokens = "select chr(b::int) as s, printf('%02X', b) as h from range(256) t(b)"
    out.append(f"s{tag}0 as materialized (" + (f"select * from (select distinct {by} from w{tag}0), ({tokens})" if by else tokens) + ")")
    for r in range(steps):
        w, s, t = f"w{tag}{r}", f"s{tag}{r}", f"t{tag}{r}"
        counts = f"select {key}p, sum(weight)::bigint as n from (select {key}weight, unnest(list_transform(list_zip(c[:-2], c[2:]), lambda x: x[1] || x[2])) as p from (select *, string_split(w, '') as c from {w})) group by {key}p having sum(weight) >= {config.min_frequency}"
        on = f"c.{by} = {{0}}.{by} and " if by else ""
        known = f"exists (select 1 from {s} k where {'k.' + by + ' = x.' + by + ' and ' if by else ''}k.h = x.h)"
        out.append(
            f"{t} as materialized (select {key}p, n, h, lh, rh from (select {key}p, n, h, lh, rh, row_number() over ({part}order by n desc, p) as place from ("
            f"select {'c.' + by + ', ' if by else ''}p, n, a.h || b.h as h, a.h as lh, b.h as rh from ({counts}) c join {s} a on {on.format('a')}a.s = substr(p, 1, 1) join {s} b on {on.format('b')}b.s = substr(p, 2, 1)) x"
            f" where length(h) in ({lengths}) and {_rules(config, 'h')} and h not in ({special}) and not {known}) where place = 1)"
        )
        c = _char(config, r)
        if by:
            out.append(f"w{tag}{r + 1} as materialized (select {by}, coalesce(replace(w, p, '{c}'), w) as w, weight, length(w) as before from {w} left join {t} {using} where length(w) > 1)")
        else:
            out.append(f"w{tag}{r + 1} as materialized (select coalesce(replace(w, (select p from {t}), '{c}'), w) as w, weight, length(w) as before from {w} where length(w) > 1)")
        out.append(f"s{tag}{r + 1} as materialized (select * from {s} union all select {key}'{c}', h from {t})")
    return out


def _merge_rows(steps: int, tag: str = "") -> str:
    return " union all ".join(f"select {r}::int as rank, p, n, h, lh, rh, (select sum(weight * (before - length(w)))::bigint from w{tag}{r + 1}) as applied from t{tag}{r}" for r in range(steps))


def merges(config: TrainerConfig, words: str, metrics: bool = True) -> str:
    steps = config.merge_budget
    more = ", n as best_frequency, applied as merges_applied" if metrics else ""
    p = {x: _id(f"substr(p, {i}, 1)") for i, x in ((1, "left"), (2, "right"))}
    return f"""with {", ".join(_trained(config, words, steps))} select rank, {p["left"]} as "left", {p["right"]} as "right", ({config.base_size} + rank)::int as new_id{more} from ({_merge_rows(steps)})"""


def plateau(config: TrainerConfig, words: str, patience: int, divisor: int) -> str:
    """The merges before the patience-th pair in a row whose count times divisor is at most the first one's."""
    rows = merges(config, words)
    low = f"(best_frequency * {divisor} <= first_value(best_frequency) over (order by rank))::int"
    found = f"select *, sum(low) over (order by rank rows between {patience - 1} preceding and current row) as streak from (select *, {low} as low from ({rows}))"
    ended = f"select *, coalesce(max((streak >= {patience})::int) over (order by rank), 0) as over_ from ({found})"
    return f"""select rank, "left", "right", new_id, best_frequency, merges_applied, case when max(over_) over () = 1 then 'plateau_reached' else 'target_vocab_reached' end as stop_reason from ({ended}) qualify over_ = 0"""


def vocabulary(config: TrainerConfig, words: str, most: int | None = None) -> str:
    steps = config.merge_budget if most is None else min(most, config.merge_budget)
    alphabet = gpt2_alphabet().replace("'", "''")

    def shown(h: str) -> str:
        return f"array_to_string(list_transform(regexp_extract_all({h}, '..'), lambda x: substr('{alphabet}', ('0x' || x)::int + 1, 1)), '')"

    fixed = [(i, t.encode().hex().upper(), "leading", t) for i, t in enumerate(layout.LEADING)]
    rows = ["select * from (values " + ", ".join(f"({i}, '{h}', '{kind}', '{t}')" for i, h, kind, t in fixed) + ") v(id, bytes, kind, token)"]
    rows.append(f"select {layout.FIRST_BYTE} + b, printf('%02X', b), 'byte', substr('{alphabet}', b::int + 1, 1) from range(256) t(b)")
    glyphs = ", ".join(f"({layout.FIRST_TRAILING + i}, '{t.encode().hex().upper()}')" for i, t in enumerate(config.trailing))
    rows.append(f"select id, h, 'reasoning', {shown('h')} from (values {glyphs}) v(id, h)")
    rows.append(f"select {config.base_size} + rank, h, 'merge', {shown('h')} from ({_merge_rows(steps)})")
    left = config.merge_budget - steps
    runs = [f"{b:02X}" * n for n in range(2, left + 2) for b in b" \t\n\r"]
    if left:
        pads = ", ".join(f"({i}, '{h}')" for i, h in enumerate(runs))
        free = f"select h, row_number() over (order by place) - 1 as i from (values {pads}) v(place, h) where h not in (select h from s{steps})"
        rows.append(f"select {config.base_size + steps} + i, h, 'padding', {shown('h')} from ({free}) where i < {left}")
    return f"with {', '.join(_trained(config, words, steps))} select id::int as id, bytes, kind, token from ({' union all '.join(rows)})"


def overlap(config: TrainerConfig, one: str, two: str, k: int) -> str:
    steps = config.merge_budget
    tables = [*_trained(config, one, steps), *_trained(config, two, steps, tag="b"), f"x as materialized ({_merge_rows(steps)})", f"y as materialized ({_merge_rows(steps, 'b')})"]
    tables += ["m as (select max(rank) as a, (select max(rank) from y) as b from x)"]
    shared = "(select count(*) from x join y on x.lh = y.lh and x.rh = y.rh where {})::int"
    lengths = " union all ".join([f"select length(h) / 2 as n from s{steps}", *(f"select {len(t.encode())}" for t in (*layout.LEADING, *config.trailing))])
    return f"""with {", ".join(tables)} select {shared.format("true")} as "all", {shared.format(f"x.rank < {k} and y.rank < {k}")} as top,
        {shared.format(f"x.rank > (select a from m) - {k} and y.rank > (select b from m) - {k}")} as bottom,
        (select round(avg(n), 9) from ({lengths})) as avg_len, (select round(avg((n >= 8)::int), 9) from ({lengths})) as share_ge8"""


def _coded(text: str) -> str:
    """The characters of a text's tokens."""
    out = _CHARS.format(text)
    for i, t in enumerate(layout.LEADING):
        out = f"replace({out}, '{t}', '{layout.char_of(i)}')"
    return out


def _encoded(config: TrainerConfig, text: str, steps: int) -> list[str]:
    """Tables e0 ... of the documents' tokens after each merge."""
    out = [f"e0 as materialized (select doc_id, {_coded(text)} as e from documents)"]
    for r in range(0, steps, 16):
        some = range(r, min(r + 16, steps))
        e = "e"
        for i in some:
            e = f"coalesce(replace({e}, (select p from t{i}), '{_char(config, i)}'), {e})" if i == r else f"replace({e}, coalesce((select p from t{i}), '<none>'), '{_char(config, i)}')"
        out.append(f"e{some[-1] + 1} as materialized (select doc_id, {e} as e from e{r})")
    return out


def encoded(config: TrainerConfig, words: str, text: str) -> str:
    steps = config.merge_budget
    tables = [*_trained(config, words, steps), *_encoded(config, text, steps)]
    ids = f"list_transform(list_filter(string_split(e, ''), lambda c: c <> ''), lambda c: {_id('c')})"
    return f"with {', '.join(tables)} select doc_id, length(e)::int as n_tokens, md5(array_to_string({ids}, ',')) as digest from e{steps}"


def sampled(config: TrainerConfig, words: str, text: str, n: int) -> str:
    """Tokens of the first n bytes with and without merges; a byte that goes on a character after them makes them Latin-1."""
    steps = config.merge_budget
    h = f"hex(encode({text}))"
    split = f"substr({h}, {2 * n + 1}, 1) in ('8', '9', 'A', 'B')"
    first = f"regexp_extract_all(substr({h}, 1, {2 * n}), '..')"
    wide = f"list_transform({first}, lambda x: case when ('0x' || x)::int < 128 then x when ('0x' || x)::int < 192 then 'C2' || x else 'C3' || printf('%02X', ('0x' || x)::int - 64) end)"
    bytes_ = f"regexp_extract_all(array_to_string(case when {split} then {wide} else {first} end, ''), '..')"
    chars = f"array_to_string(list_transform({bytes_}, lambda x: chr(('0x' || x)::int)), '')"
    tables = [*_trained(config, words, steps), *_encoded(config, text, steps)]
    tables[len(_trained(config, words, steps))] = f"e0 as materialized (select doc_id, {chars} as e from documents)"
    return f"with {', '.join(tables)} select e0.doc_id, length(e{steps}.e)::int as merged, length(e0.e)::int as plain from e0 join e{steps} using (doc_id)"


_DOC_CHUNKS = """select doc_id * 1048576 + i as index, substr(h, 65536 * i::bigint + 1, 65536) as h from (
  select doc_id, h, unnest(range((length(h) + 65535) // 65536)) as i from (select doc_id, hex(encode(coalesce(text, ''))) as h from documents))"""
_CHUNK_ENTROPY = f"""select index, any_value(h) as h, sum(c) as byte_len, greatest(0.0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) as entropy from (
  select index, any_value(h) as h, b, count(*) as c from (select index, h, unnest(regexp_extract_all(h, '..')) as b from ({_DOC_CHUNKS})) group by index, b) group by index"""


def chunks(config: TrainerConfig, mode: str) -> str:
    """Training of each distinct chunk, combined; the merges as hex."""
    steps = config.merge_budget
    # Bytes of a chunk as characters, cut at ASCII white space.
    text = "array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x: chr(('0x' || x)::int)), '')"
    words = f"select index, unnest(regexp_extract_all({text}, '[\\t-\\r ]+|[^\\t-\\r ]+')) as w from one"
    tables = [f"c as materialized ({_CHUNK_ENTROPY})", "one as materialized (select min(index) as index, h from c group by h)"]
    trained = _trained(config, "select 1", steps, "index")
    trained[0] = f"w0 as materialized (select index, w, count(*) as weight from ({words}) group by index, w having length(w) > 1)"
    if mode == "first":
        rows = " union all ".join(f"select {r} as rank, index, lh, rh from t{r}" for r in range(steps))
        return f"""with {", ".join([*tables, *trained])} select rank::int as rank, lh as "left", rh as "right" from ({rows}) where index = (select min(index) from c)"""
    tables += trained
    found = " union all ".join(f"select index, lh, rh, n from t{r}" for r in range(steps))
    raw = "greatest(0.1, least(1.0, entropy / 8)) * greatest(0.5, least(2.0, sqrt(byte_len / avg(byte_len) over ())))"
    tables.append(f"weights as (select index, h, raw / sum(raw) over () as weight from (select index, h, {raw} as raw from c))")
    tables.append(f"offers as (select f.lh, f.rh, f.n, weights.weight from ({found}) f join one using (index) join weights on weights.h = one.h)")
    tables.append("combined as (select lh, rh, sum(n) as total, count(*) as support, sum(n * weight) as weighted from offers group by lh, rh)")
    by = {"frequency": "total desc, support desc", "support": "support desc, total desc", "entropy": "round(weighted, 6) desc, support desc, total desc"}[mode]
    where = "where support >= 2" if mode == "entropy" else ""
    tables.append(f"candidates as materialized (select list({{'l': lh, 'r': rh}} order by {by}, length(lh) + length(rh), lh, rh) as todo from combined {where})")
    base = ", ".join(f"'{t}'" for t in [*(x.encode().hex().upper() for x in (*layout.LEADING, *config.trailing)), *(f"{b:02X}" for b in range(256))])
    # One candidate a row: it is taken, waits for the next pass, or is one that is there already. A pass without a merge is the last.
    state = "todo, i, later, known, made, grown"
    ready = "list_contains(known, todo[i].l) and list_contains(known, todo[i].r)"
    there = "list_contains(known, todo[i].l || todo[i].r)"
    tables.append(
        f"""steps as (
      select todo, 1 as i, todo[1:0] as later, [{base}] as known, todo[1:0] as made, false as grown from candidates
      union all
      select case when i > len(todo) then later else todo end, case when i > len(todo) then 1 else i + 1 end,
             case when i > len(todo) then todo[1:0] when {ready} then later else list_append(later, todo[i]) end,
             case when i <= len(todo) and {ready} and not {there} then list_append(known, todo[i].l || todo[i].r) else known end,
             case when i <= len(todo) and {ready} and not {there} then list_append(made, todo[i]) else made end,
             case when i > len(todo) then false else grown or ({ready} and not {there}) end
      from (select {state} from steps) where len(made) < {steps} and (i <= len(todo) or (grown and len(later) > 0)))"""
    )
    last = "select made from steps order by len(made) desc limit 1"
    return f"""with recursive {", ".join(tables)} select (i - 1)::int as rank, made[i].l as "left", made[i].r as "right" from (select made, unnest(range(1, len(made) + 1)) as i from ({last}))"""


def chunk_report(low: float, high: float) -> str:
    inside = f"entropy between {low} and {high}"
    rows = f"select *, index = min(index) over (partition by h) as head from ({_CHUNK_ENTROPY})"
    counts = f"""select count(*) as processed, count(*) filter ({inside}) as kept, count(*) filter (head and {inside}) as kept_heads, count(*) filter (head) as uniques,
      count(*) filter (head and entropy < {low}) as low, count(*) filter (head and entropy > {high}) as high, count(*) filter (not head and {inside}) as repeats from ({rows})"""
    return f"""select how as duplicates, processed, case when how = 'count' then kept else kept_heads end as total, uniques, low, high,
      case when how = 'unique' then repeats else 0 end as skipped, case when how = 'count' then repeats else 0 end as reused from ({counts}), (values ('unique'), ('count')) v(how)"""
