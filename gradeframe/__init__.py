"""gradeframe: score question-answering predictions and compare systems on Spark.

Every public function is ``DataFrame -> DataFrame`` or ``Column -> Column``;
nothing runs until the caller asks for an action, except where a docstring
says otherwise.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Kernels travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
