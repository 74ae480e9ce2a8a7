"""Query catalog: each module registers queries with matching oracle SQL."""
