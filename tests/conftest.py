import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from inkbasin.session import session

    own = session(4, spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}", spark__driver__memory="4g", spark__sql__execution__arrow__maxRecordsPerBatch="500")
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()
