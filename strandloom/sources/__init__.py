"""Sources of strandloom."""
