"""Query front ends: the JSON verbs, guarded SQL, pattern queries, limits, timeouts and results."""
