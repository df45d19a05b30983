"""corvane: leakage-aware evaluation and corpus preparation as Spark jobs."""
