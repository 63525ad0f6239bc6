import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import checkpoint_dir, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    checkpoint_dir(s)
    yield s
    s.stop()


def ts(text: str) -> dt.datetime:
    """UTC timestamp; naive values would be read in the machine's zone."""
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)
