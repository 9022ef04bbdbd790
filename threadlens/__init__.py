"""Message-archive analytics expressed as Spark DataFrame jobs."""
