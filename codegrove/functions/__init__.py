"""Column builders: text, hashing, vectors, prompt formats."""
