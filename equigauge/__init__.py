"""equigauge: regional-inequality analytics as Spark DataFrame plans."""

from equigauge.config import Bands, Study, health_study

__all__ = ["Bands", "Study", "health_study"]
