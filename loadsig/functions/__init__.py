"""Column expressions: calendar marks and the signature model."""
