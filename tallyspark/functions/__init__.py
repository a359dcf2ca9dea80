"""Column functions: text extraction and nested task properties."""
