"""Sources of the paired-evaluation engine."""
