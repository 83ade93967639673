"""Registered queries of the engine against their SQL, over small tables."""

import random

import duckdb
import pytest

from byteloom.plans import catalog

#: Queries whose SQL takes long to plan, and which others stand for here.
SLOW = {"train_vocabulary", "train_merges_spark", "train_plateau", "derived_merges", "chunk_train_frequency", "chunk_train_first", "encode_by_heap", "models_compared"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["".join(rng.choice("the an er on in re st ing é ß 中".split()) for _ in range(rng.randint(1, 3))) for _ in range(60)]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "\u2003", "."]) for _ in range(n))

    rows = [(i, text(rng.randint(3, 400)), "en", f"s{i % 3}", i) for i in range(40)] + [(40, None, None, "s0", None), (41, "", "en", "s1", 0)]
    rows += [(50 + i, rows[i][1], "en", "s2", i) for i in range(6)] + [(60, " \n ", "de", "s2", 3)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, text(50)) for i in range(5)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, f'{{"k": {i}}}') for i in range(9)], "event_id long, props string").write.parquet(f"{out}/events.parquet")
    return out


def shown(x):
    return repr(round(x, 8)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in SLOW])
def test_query_gives_the_rows_of_its_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "events"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, folder)
    got = sorted([shown(r[c]) for c in sorted(df.columns)] for r in df.collect())
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    assert got == sorted([shown(r[i]) for i in order] for r in found.fetchall())
    assert got or name in ("entropy_filtered_docs",)


def test_every_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
