"""heddle: data-lineage analytics as Spark jobs over normalised tables."""
