"""Review-opinion analytics as Spark DataFrame operators."""

from opinara.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
