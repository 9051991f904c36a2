"""Record tables: readers, projections and writers."""
