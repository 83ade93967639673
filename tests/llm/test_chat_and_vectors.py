import random

import numpy as np
from pyspark.sql import functions as F

from byteloom.llm import chat_format, embedding_dedup

EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"
ORDER = lambda e: (e[1], e[2], e[3], e[4] is not None, e[4] or "", e[5] is not None, e[5] or "")


def folded(events):
    out = {}
    for conv in {e[0] for e in events if e[0] is not None}:
        live, roles = {}, {}
        own = sorted({e for e in events if e[0] == conv and e[1] is not None and e[2] is not None and e[3] in chat_format.KINDS}, key=ORDER)
        for _, _, turn, kind, role, text in own:
            if role is not None:
                roles[turn] = role
            if kind in ("edit", "regenerate"):
                live = {t: x for t, x in live.items() if t <= turn}
            if kind in ("message", "edit", "regenerate"):
                live[turn] = text or ""
            elif kind == "delta":
                live[turn] = live.get(turn, "") + (text or "")
            else:
                live.pop(turn, None)
        for t, x in live.items():
            out[(conv, t)] = (roles.get(t, "user"), x)
    return out


def test_fold_matches_a_sequential_fold(spark):
    rng = random.Random(1)
    events = []
    for conv in range(40):
        for seq in range(rng.randint(1, 25)):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete"])
            events.append((conv, rng.choice([seq, seq, 3]), rng.randint(0, 4), kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "b ", "", None, f"t{seq}"])))
    events += [(None, 1, 1, "message", "user", "x"), (1, None, 1, "message", "user", "x"), (1, 1, None, "message", "user", "x"), (1, 1, 1, "other", "user", "x"), events[0], events[0]]
    df = spark.createDataFrame(events, EVENTS).withColumn("at", F.lit(1)).withColumn("live", F.lit(1))
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat_format.messages(df).collect()}
    assert got == folded(events)


def test_transcripts(spark):
    rows = [(1, 0, "system", "Be <|kind|>"), (1, 1, "user", "Hi\nthere\n"), (1, 2, "assistant", None), (2, 0, None, ""), (None, 0, "user", "x"), (3, None, "user", "x"), (4, 0, "user", "w " * 30_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    got = {r.conv_id: (r.n_messages, r.transcript) for r in chat_format.format_conversations(turns).collect()}
    assert got[1] == (3, "<|im_start|>system\nBe < |kind|><|im_end|>\n<|im_start|>user\nHi\nthere\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    assert got[2] == (1, "<|im_start|>user\n<|im_end|>\n") and set(got) == {1, 2, 4}
    assert len(got[4][1]) == 60_000 + len("<|im_start|>user\n<|im_end|>\n")
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_rows_of_one_turn_are_messages_of_their_own(spark):
    rows = [(1, 0, "user", "c\nd\n"), (1, 0, "user", "a\nb\n"), (1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "assistant", "y"), (1, 1, None, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = chat_format.format_conversations(turns).collect()
    order = [("user", "a\nb\n"), ("user", "c\nd\n"), ("user", "z"), ("assistant", "y"), ("user", "x"), ("user", "x")]
    assert got.n_messages == 6  # count(*) of the SQL
    assert got.transcript == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in order)


def test_logs_of_tables_have_every_kind_of_event_and_fold_to_the_table(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "one\ntwo\n", "x " * 30, f"t{t}"])) for c in range(30) for t in range(rng.randint(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat_format.events_of(turns).cache()
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat_format.KINDS)
    events = [(r.conv_id, int(r.seq), r.turn, r.kind, r.role, r.text) for r in log.collect()]
    expected = {(c, t + 1): (role or "user", text or "") for c, t, role, text in rows}
    assert folded(events) == expected
    assert {(r.conv_id, r.turn): (r.role, r.text) for r in chat_format.messages(log).collect()} == expected


def near(rng, x, cos):
    u = rng.normal(size=x.shape)
    u -= (u @ x) * x
    u /= np.linalg.norm(u)
    return cos * x + np.sqrt(1 - cos * cos) * u


def vectors(seed=0, n=1500):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    copies = [near(rng, base[i], c) for i in range(300) for c in (0.955, 0.98)] + [near(rng, base[0], 0.99) for _ in range(200)] + [base[1] * 4]
    return np.concatenate([base, copies]).astype(np.float32)


def test_recall_against_brute_force(spark):
    v = vectors()
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    root = list(range(len(v)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    unit[-1] = unit[1]  # the copy of four times the length
    near = unit @ unit.T >= embedding_dedup.SIMILARITY
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    near[:, -1] = False  # equal vectors are one
    links = near.sum(axis=1) - 1
    links[-1] = links[1]
    grouped = [i for i in range(len(v)) if find(i) != i or links[i] > 0]
    for cap in (embedding_dedup.CAP, 30):
        found = {r.vec_id: (r.class_id, r.links) for r in embedding_dedup.near_duplicates(df, cap=cap).collect()}
        assert len(found) == len(v) and all(found[i] == (i, 0) for i in set(range(len(v))) - set(grouped))
        assert sum(found[i][0] == find(i) for i in grouped) >= 0.95 * len(grouped)
        assert all(found[i][1] <= links[i] for i in grouped)
        assert sum(found[i][1] for i in grouped) >= 0.9 * links.sum()


def test_chains_of_similar_vectors_stay_together(spark):
    rows = []
    for plane in range(24):
        for i in range(4):  # neighbours are 17 degrees apart, cosine 0.956; others 34 and more
            v = np.zeros(48)
            v[2 * plane], v[2 * plane + 1] = np.cos(np.radians(17 * i)), np.sin(np.radians(17 * i))
            rows.append((4 * plane + i, v.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.class_id, r.links) for r in embedding_dedup.near_duplicates(df).collect()}
    assert found == {i: (i - i % 4, 1 + (i % 4 in (1, 2))) for i in range(96)}


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.001]), (1, [1.0, 0.0]), (9, [0.0, 1.0]), (10, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("k", F.lit(1)).withColumn("vec", F.lit(1))
    found = sorted(((r.vec_id, r.class_id, r.links) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    # 1, 1 and 2 are one vector; the row without an id is its only link.
    assert found == sorted([(1, None, 1), (1, None, 1), (2, None, 1), (None, None, 1)] + [(i, i, 0) for i in (3, 4, 5, 6, 7, 8, 9, 10)], key=str)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df.where("vec_id = 4")).collect()] == [(4, 4, 0)]
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df.where("vec_id = 9")).collect()] == [(9, 9, 0)]


def test_tied_pivots_are_those_drawn_first(spark):
    # All vectors lie on the axes, so most pivots are as near as others.
    rows = [(i, [float(j == i % 40) * (1 + i) for j in range(40)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for _ in range(2):
        assert {r.vec_id: (r.class_id, r.links) for r in embedding_dedup.near_duplicates(df).collect()} == {i: (i % 40, 0) for i in range(120)}
