"""textflow: text-difficulty analytics and review ledgers as Spark jobs."""
