"""Analysis operators: one module per question family."""
