"""Evidence linkage and funnel analytics on Spark."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
