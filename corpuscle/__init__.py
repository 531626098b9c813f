"""corpuscle: retrieval, text analytics and graph patterns as DataFrame operators on plain Spark SQL."""
