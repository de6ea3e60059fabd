"""urlguard: phishing-URL analytics expressed as Spark jobs."""
