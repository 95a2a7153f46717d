"""Training-data operators: quality, toxicity, search, fingerprints, packing, output.

Nothing else in the library imports this subpackage; ``queries.queries()`` and
``queries.oracle_sql()`` are its only entry points for the driver contract.
"""
