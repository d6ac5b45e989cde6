import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    for f in [*(ROOT / "sparkpact").rglob("*.py"), ROOT / "bench.py"]:
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\s+(sparkpact\.llm|corpus_pipeline)", f.read_text()), f


def test_queries_have_sql():
    from sparkpact import queries as Q

    assert set(Q.QUERIES) == set(Q.ORACLE_SQL)
