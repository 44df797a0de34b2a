"""Column expressions shared by every operator."""
