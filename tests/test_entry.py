"""The driver contract, with and without the training-data part."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as contract
from weft.catalogue import CATALOGUE

TOP = Path(contract.__file__).parent


def test_contract(spark):
    q, sql = contract.queries(), contract.oracle_sql()
    assert CATALOGUE.keys() <= q.keys() and sql.keys() <= q.keys() and CATALOGUE.keys() <= sql.keys()
    assert contract.entry(spark).columns == ["value"]


def test_the_rest_works_without_the_training_data_part(tmp_path):
    for p in [TOP / "__spark_entry__.py", *TOP.glob("weft/**/*.py")]:
        if "llm" not in p.parts:
            new = tmp_path / p.relative_to(TOP)
            new.parent.mkdir(parents=True, exist_ok=True)
            new.write_text(p.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any('op' in k[:2] and k[2:3].isdigit() for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(CATALOGUE))] * 2 + ["False"], said.stderr
