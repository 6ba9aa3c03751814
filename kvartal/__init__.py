"""Address standardisation, change merge, reference look-up and routing as Spark jobs."""
