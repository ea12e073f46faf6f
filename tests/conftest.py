import pytest

from gridstone.session import build

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return build("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def sf():
    return SF
