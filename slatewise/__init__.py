"""slatewise: offline recommender analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus small scalar parameters)
and returns a DataFrame. Nothing is collected to the driver except
small parameters such as a cutoff timestamp.
"""

from slatewise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
