import pytest
from oracle import DIR, connect, same

import postlake.plans.anchor_plans
import postlake.plans.audit_plans
import postlake.plans.delivery_plans
import postlake.plans.lifecycle_plans
import postlake.plans.repair_plans
import postlake.plans.search_plans
import postlake.plans.state_plans  # noqa: F401
from postlake.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    same(QUERIES[name](spark, DIR), SQL[name], con)
