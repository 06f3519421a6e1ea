"""Column expressions: text, vectors, prompts."""
