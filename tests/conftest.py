import pytest

from skein.session import ensure_checkpoint_dir, local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", 8)
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


def rows_of(frame):
    """Sorted tuples of a frame's rows."""
    return sorted((tuple(r) for r in frame.collect()), key=repr)
