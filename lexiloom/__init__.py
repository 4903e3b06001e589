"""lexiloom: text-corpus analytics on PySpark."""
