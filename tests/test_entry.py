import subprocess
import sys

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 45


def test_import_without_the_text_operators(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('orthoweave.llm'):\n"
        "            raise ModuleNotFoundError('gone', name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        f"sys.path.insert(0, {entry._HERE!r})\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 40 and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']\n"
        "assert e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
