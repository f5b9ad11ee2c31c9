"""Training-data operators: sharding, language ID, sketches, tokenising, filters and deduplication.

Nothing outside this package imports it. Each module holds one operator with its own general interface;
``queries`` turns them into the registered queries.
"""
