"""Column-level helpers: dates, arrays and code vectors, text layout."""
