"""Every query on empty tables, and on tables full of nulls, repeated rows and columns of clashing names."""

import os

import pytest

from evograph import catalog
from tables import SOURCE, variant


@pytest.mark.skipif(not os.path.exists(SOURCE), reason="no test tables here")
@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_all_queries(spark, tmp_path, kind):
    d = variant(kind, str(tmp_path))
    failed = {}
    for name, q in catalog.queries().items():
        try:
            q(spark, d).collect()
        except Exception as e:  # noqa: BLE001
            failed[name] = str(e)[:200]
    assert not failed
