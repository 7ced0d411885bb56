"""Graph, search, diff and validation queries over code-knowledge tables, on Spark."""
