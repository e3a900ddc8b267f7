import subprocess
import sys


def test_entry_without_the_optional_parts():
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == 'weftline.llm' or name.startswith('weftline.llm.') or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not any(q.startswith('op1_') for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0], timeout=120)


def test_entry_runs(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 5 and sum(r["n"] for r in rows) > 0
