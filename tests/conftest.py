import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cloakframe.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests", "8", spark__sql__legacy__javaCharsets="true", spark__sql__legacy__codingErrorAction="true",
        spark__sql__shuffle__partitions="4",
    )
    yield session
    session.stop()
