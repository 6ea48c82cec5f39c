"""fernwork: content-site analytics as PySpark DataFrame operators."""
