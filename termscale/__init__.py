"""Okapi BM25 text ranking as Spark DataFrame jobs: top-k documents and top-k words."""
