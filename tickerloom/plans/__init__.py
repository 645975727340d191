"""Driver queries: the test views, the queries by name, and their oracles."""
