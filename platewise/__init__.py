"""platewise: venue (restaurant) analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver and no Python function runs per
row; the work is expressed with built-in Spark SQL expressions so Catalyst can
prune, push down and code-generate it.
"""

from platewise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
