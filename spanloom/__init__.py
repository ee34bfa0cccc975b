"""spanloom: structure-preserving document translation and text-region processing on PySpark."""
