"""A PySpark engine for packing defects of membrane simulations, and operators of training-data pipelines."""
