"""Text and embedding operators for preparing training data. Nothing outside this folder imports it."""
