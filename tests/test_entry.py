"""The entry point, with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_every_query_of_the_engine_has_sql_or_is_known_not_to():
    from stemline import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"suffix_array_documents"}


def test_entry_works_without_the_corpus_subpackage(tmp_path):
    for x in ("stemline", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", ROOT / x, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "stemline" / "llm"], check=True)
    code = "import __spark_entry__ as e; assert 'suffix_array' in e.queries(); assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
