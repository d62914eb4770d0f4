import pathlib
import sys

import pytest
from pyspark import cloudpickle

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from sievework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__driver__memory="6g", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(autouse=True, scope="module")
def ship_test_functions(request):
    """Functions defined in a test module are pickled whole, as the workers cannot import it."""
    cloudpickle.register_pickle_by_value(request.module)
    yield
    cloudpickle.unregister_pickle_by_value(request.module)
