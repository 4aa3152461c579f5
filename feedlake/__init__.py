"""Feed and news analytics as Spark DataFrame transforms.

``sources``    readers and writers (tables, XML bodies, NDJSON logs, event frames)
``functions``  Column expressions, all built on Spark's own functions
``operators``  DataFrame -> DataFrame transforms
``streaming``  Structured Streaming jobs around the same transforms
``plans``      the registered queries and the SQL they are checked against
"""
