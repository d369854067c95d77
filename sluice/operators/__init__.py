"""Relational operators as thin DataFrame compositions: Catalyst plans them."""

from sluice.operators.relational import (
    adaptive_join,
    distinct_estimate,
    filter_greater,
    filter_mask,
    global_aggregate,
    hash_aggregate,
    join,
    limit_offset,
    project,
    salted_join,
    select_where,
    shard,
    sort,
    sort_key_value,
    tier_merge,
    top_n_per_group,
)

__all__ = [
    "adaptive_join", "distinct_estimate", "filter_greater", "filter_mask", "global_aggregate", "hash_aggregate", "join",
    "limit_offset", "project", "salted_join", "select_where", "shard", "sort", "sort_key_value", "tier_merge", "top_n_per_group",
]
