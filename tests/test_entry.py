"""The entry module."""

import subprocess
import sys
import textwrap


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_package():
    code = """
        import sys
        class Gone:
            def find_spec(self, name, path=None, target=None):
                if name in ("trackloom.llm", "corpus_pipeline"):
                    raise ImportError(name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        assert e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, timeout=120)
