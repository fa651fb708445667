"""Translation-memory and corpus analytics on Spark."""
