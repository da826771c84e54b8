import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

REPO = Path(__file__).parent.parent
DATA = Path("/root/testdata/sf0.001")
#: A sample of queries that run quickly; the driver compares all of them.
FAST = ["a4_status_mix", "a8_facet_counts", "a16_float_mix", "q01_checks", "w2_owner_ranks", "s3_records", "p4_found", "p5_found"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_text_package():
    for path in (REPO / "schedlake").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("schedlake.llm") for n in names), path


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, str(DATA))
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    plain = lambda rows: sorted(([str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r] for r in rows))
    assert plain([[r[c] for c in order] for r in got.collect()]) == plain([[r[names.index(c)] for c in order] for r in want.fetchall()])
