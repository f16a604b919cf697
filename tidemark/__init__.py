"""tidemark: discovery-record and benchmark analytics as PySpark DataFrame operators."""
