"""Column-expression helpers (pure ``pyspark.sql.functions`` compositions)."""

from paritylab.functions.hashing import hash_bucket, hash_key, hash_unit
from paritylab.functions.keys import composite_key, key_string
from paritylab.functions.stats import erf, normal_cdf, parity_p_value, is_significant

__all__ = [
    "hash_key", "hash_unit", "hash_bucket", "composite_key", "key_string",
    "erf", "normal_cdf", "parity_p_value", "is_significant",
]
