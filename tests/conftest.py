import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from scrubline.session import local_session, ship

    made = local_session(4, 4)
    made.sparkContext.setLogLevel("ERROR")
    ship(made)
    yield made
    made.stop()
