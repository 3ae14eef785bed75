"""Every registered query against its SQL in another engine, and that the kernels return rows."""

import pytest

from crossgrain.plans import catalog
from tests.conftest import duck, same_as_oracle

ORACLE = catalog.oracle_sql()
KERNELS = sorted(set(catalog.queries()) - set(ORACLE))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, sf_dir, name):
    assert same_as_oracle(catalog.queries()[name](spark, sf_dir), ORACLE[name], duck(sf_dir))


@pytest.mark.parametrize("name", [k for k in KERNELS if not k.startswith("x_")])
def test_kernel_has_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
