"""quayside: message-to-report data processing as PySpark DataFrame functions.

Every operator takes DataFrames (or columns) and returns DataFrames (or columns);
nothing here collects data to the driver.
"""

import sys

from pyspark import cloudpickle

from quayside.session import build_session, prepare

# Executors get this package's few Python functions with the task, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "prepare"]
