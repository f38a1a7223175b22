"""Plan building blocks shared by operators: skew-safe joins, connected components, hashed bitmaps."""
