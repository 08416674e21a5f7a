import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quernstone.session import build_session

    return build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
