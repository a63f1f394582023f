"""Hybrid (facet + vector) search over product catalogs, as Spark jobs."""
