"""spanveil: detection, resolution, pseudonymisation and restoration of sensitive spans, as Spark plans."""

import sys

from pyspark import cloudpickle

# executors get the package's functions with the tasks, so they need no installation of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
