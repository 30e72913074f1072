"""DataFrame operators: alignment, ranks, books and statistics."""
