"""Training-data operators: ten self-contained modules over the table ``documents``.

Nothing outside this package imports it. ``queries`` lists the driver queries,
``oracles`` the DuckDB texts for those that SQL can express.
"""
