"""Query text to algebra."""
