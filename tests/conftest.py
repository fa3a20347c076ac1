import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))



@pytest.fixture(scope="session")
def spark():
    from trustweave.session import free_scratch, local_session

    session = local_session("tests", 8)
    yield session
    free_scratch(session)
    session.stop()


@pytest.fixture
def workspace(spark):
    from trustweave.plans.workspace import Workspace

    return Workspace(spark)
