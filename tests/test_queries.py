"""Every series query of the catalogue against its SQL; the entry module with and without the corpus part."""

from __future__ import annotations

import subprocess
import sys

import pytest
from conftest import ROOT

import __spark_entry__
from tidewatch.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, same_as_sql, name):
    if name in catalog.ORACLE:
        assert same_as_sql(catalog.QUERIES[name], catalog.ORACLE[name], SF) > 0
    else:
        assert catalog.QUERIES[name](spark, SF).count() == catalog.daily(spark, SF).count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_part(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run(
        f"cp -r {ROOT}/tidewatch {ROOT}/__spark_entry__.py {tmp_path} && rm -rf {tmp_path}/tidewatch/llm && cd {tmp_path} && {sys.executable} -c \"{code}\"",
        shell=True, check=True, env={"PATH": "/usr/bin:/bin"},
    )
