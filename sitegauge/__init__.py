"""Site-intelligence and planning-friction analytics expressed as Spark DataFrame jobs."""
