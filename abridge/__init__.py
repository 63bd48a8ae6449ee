"""abridge: text-compression evaluation and surface-distance jobs on Spark.

Every public function takes and returns DataFrames (or Columns); nothing
is collected to the driver except per-round control values.
"""

__version__ = "0.1.0"
