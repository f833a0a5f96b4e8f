"""Column expressions for text, places, angles and time of day."""
