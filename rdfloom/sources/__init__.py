"""Where triples come from."""
