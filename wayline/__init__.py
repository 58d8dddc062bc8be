"""Object-track analytics as plain PySpark DataFrame transformations."""
