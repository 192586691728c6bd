"""Evidence grading, claim lineage and training-data operators as Spark jobs."""
