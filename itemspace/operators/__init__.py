"""DataFrame -> DataFrame operators: cleaning, scoring, vectors, encoding,
reduction, clustering, metrics, comparison and report tables."""
