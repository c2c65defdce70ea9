"""Operators for preparing training text; nothing outside this package imports it.

Functions that run in tasks travel with the tasks, so executors need not have this
package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
