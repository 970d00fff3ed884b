"""Column functions: text and vectors, all inside Catalyst."""
