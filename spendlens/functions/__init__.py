"""Column expressions: recodes and null/zero-aware arithmetic."""
