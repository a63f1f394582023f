"""The given tables as a catalog with vectors and requests, the registered queries, and their SQL checks."""
