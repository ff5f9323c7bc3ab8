import subprocess
import sys

HIDE = """
import sys, warnings
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {name!r} or name == {name!r}:
            raise ImportError("hidden " + name)
sys.meta_path.insert(0, Hidden())
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    import __spark_entry__ as entry
names = entry.queries()
assert "ind_pairs" in names and set(entry.oracle_sql()) <= set(names)
assert not [n for n in names if n.startswith("op")], names
assert any("left out" in str(w.message) for w in seen)
"""


def test_entry_outlives_missing_imports():
    for name in ("xxhash", "public_tokenizers", "corpus_pipeline"):
        done = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], capture_output=True, text=True, timeout=60)
        assert done.returncode == 0, done.stderr
