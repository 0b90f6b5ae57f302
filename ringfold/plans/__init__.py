"""The analytical queries, and the registered ones."""
