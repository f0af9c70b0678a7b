"""Text-evidence analytics as ordinary Spark DataFrame jobs."""
