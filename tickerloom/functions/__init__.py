"""Column functions: text and numbers, bucket terms, page fields."""
