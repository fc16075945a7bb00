"""locusloom: genetic-evidence analytics expressed as PySpark DataFrame jobs."""
