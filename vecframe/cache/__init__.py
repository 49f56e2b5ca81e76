"""Result cache of the driver: keys, eviction policies, nearest-query lookup, tiers, statistics."""
