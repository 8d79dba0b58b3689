"""DataFrame-level building blocks: ordering, reshaping, the query catalogue."""
