"""Terms, values and expressions."""
