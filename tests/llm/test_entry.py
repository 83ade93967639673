import __spark_entry__
import corpus_pipeline


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
