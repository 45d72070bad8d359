"""Array-cell stages and trained models on top of the operators."""
