import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["q_id", "rank", "vec_id", "similarity", "distance"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators():
    """The rest imports and lists its queries when skein.llm is not there."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'skein.llm' or name.startswith('skein.llm.') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError('gone', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'cosine_knn' in names and not any(n.startswith('op') for n in names if n[2:3].isdigit()), names\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
