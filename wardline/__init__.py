"""Wardline: message-risk analytics and text pipelines expressed as Spark plans."""
