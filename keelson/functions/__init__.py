"""Column-level helpers shared by the operators (all built-in Spark functions)."""

from keelson.functions.exprs import (
    clip_expr,
    format_fixed,
    nan_to_null,
    one_hot_name,
    qcol,
    to_double,
    to_label,
)
from keelson.functions.hashing import hash_uniform, hash_uniform_sql
from keelson.functions.profile import chunked_aggregate, frequency_table, null_counts, numeric_profile
from keelson.functions.quantile import exact_quantile
from keelson.functions.topk import top_k_per_group

__all__ = [
    "clip_expr", "format_fixed", "chunked_aggregate", "null_counts", "nan_to_null", "one_hot_name", "qcol", "to_double", "to_label",
    "hash_uniform", "hash_uniform_sql", "frequency_table", "numeric_profile",
    "exact_quantile", "top_k_per_group",
]
