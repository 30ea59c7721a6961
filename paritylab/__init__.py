"""paritylab: group-fairness auditing and bias mitigation as Spark DataFrame jobs."""

__version__ = "0.1.0"
