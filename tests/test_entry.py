"""The driver contract loads without any Spark jar and keeps its names paired."""
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_load_without_jars():
    code = """
import glob
glob.glob = lambda *a, **k: []
import zipfile
def refuse(*a, **k):
    raise AssertionError("no jar may be opened")
zipfile.ZipFile = refuse
import __spark_entry__ as e
from sourcinglens.plans import catalog
q, o = e.queries(), e.oracle_sql()
assert not catalog.FAILED, catalog.FAILED
assert len(q) >= 78 and set(o) <= set(q)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_stopwords_are_a_plain_list():
    from sourcinglens.functions.stopwords import default_stopwords
    words = default_stopwords()
    assert len(words) == len(set(words)) > 2000 and "the" in words and "und" in words
