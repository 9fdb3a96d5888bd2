"""Column expressions and column-adding steps shared by the operators."""
