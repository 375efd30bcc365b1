import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from calltide.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 2, "6g")
    # tiny inputs, very many plans: compiling them would take most of the time. The queries run compiled.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()
