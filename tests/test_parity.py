"""Every core query with SQL gives the same rows as its SQL on the smallest tables; the others run."""

import pytest

from tracelake.plans import core_queries, file_queries, problem_queries
from tracelake.plans.parity import differences

SF = "/root/testdata/sf0.001"
ALL = {**core_queries.QUERIES, **file_queries.QUERIES, **problem_queries.QUERIES}
TEXT = {**core_queries.SQL, **file_queries.SQL, **problem_queries.SQL}


@pytest.mark.parametrize("name", ALL)
def test_same_rows(spark, name):
    df = ALL[name](spark, SF)
    if name in TEXT:
        mine, theirs, more, less = differences(df, TEXT[name], SF)
        assert mine == theirs and not more and not less, (list(more.items())[:3], list(less.items())[:3])
    else:
        df.collect()
