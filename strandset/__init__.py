"""A PySpark engine for lineage-certified queries over text cells."""
