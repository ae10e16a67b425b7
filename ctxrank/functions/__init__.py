"""Column expressions: text, prompts and vectors."""
