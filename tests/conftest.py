import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ripplet.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.conf.set("spark.sql.crossJoin.enabled", "false")
    return session


@pytest.fixture(scope="session")
def library(spark):
    """The indexed library fixture: (index, sources)."""
    from ripplet.operators.resolve import index_files
    from tests.library import FILES

    sources = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return index_files(sources, "lib", "repository:lib", "lib"), sources
