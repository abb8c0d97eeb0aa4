"""Column functions: text, keys, vectors, answers, web outcomes."""
