import subprocess
import sys

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "{gone}":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
print(len(q), sum(n.startswith("op") for n in q), "pipeline" in q, set(o) <= set(q))
"""


def queries_without(gone):
    out = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], capture_output=True, text=True, timeout=120)
    return out.stdout.split(), out.stderr


def test_other_queries_stay_where_text_operators_cannot_be_imported():
    for gone in ("public_tokenizers", "ratingscope.llm"):
        found, error = queries_without(gone)
        assert len(found) == 4, error
        assert int(found[0]) >= 60 and found[1:] == ["0", "False", "True"], (gone, found)
