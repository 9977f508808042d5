"""corpusmill: multi-label text-corpus analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (and plain parameters) and returns a
DataFrame; nothing collects data to the driver except one-row metric rows.
"""

from corpusmill.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
