"""Entity/tag affinity analytics as Spark DataFrame jobs."""

from affinis.config import AffinityConfig, SignalTags, adopt_columns, domain_columns

__all__ = ["AffinityConfig", "SignalTags", "adopt_columns", "domain_columns"]
