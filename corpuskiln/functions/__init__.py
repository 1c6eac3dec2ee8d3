"""Part of the corpuskiln engine."""
