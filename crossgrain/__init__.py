"""Point-in-time panel and graph analytics, declared as Spark plans."""
