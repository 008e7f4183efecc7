"""A PySpark engine that audits split datasets, with operators for training-data pipelines beside it."""
