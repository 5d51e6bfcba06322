"""The queries of ``__spark_entry__`` and their SQL counterparts."""
