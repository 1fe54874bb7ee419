"""Every query of the subpackage on empty tables, and on tables full of nulls, repeated rows and clashing names."""

import os

import pytest

from evograph.llm.queries import queries
from tables import SOURCE, variant


@pytest.mark.skipif(not os.path.exists(SOURCE), reason="no test tables here")
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_all_queries(spark, tmp_path, kind):
    d = variant(kind, str(tmp_path))
    for q in queries().values():
        q(spark, d).collect()
