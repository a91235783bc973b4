"""Column functions: text, arrays, JSON, casts and display labels."""
