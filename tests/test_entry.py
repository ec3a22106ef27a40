import subprocess
import sys
from pathlib import Path


def test_core_queries_load_without_the_libraries_of_the_corpus_operators():
    code = "import sys\nfor n in ('tokenizers', 'public_tokenizers', 'sentencepiece'): sys.modules[n] = None\nimport __spark_entry__ as e\nassert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
