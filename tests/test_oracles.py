"""Every query of the reference's operators against its SQL twin, on the smallest tables."""

import pytest

from ledgerloom.plans import registry
from tests.oracle_check import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    wrong, _ = differences(spark, SF, registry.queries()[name], registry.oracle_sql()[name])
    assert wrong is None
