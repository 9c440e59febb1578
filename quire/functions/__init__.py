"""Column functions of the document model."""
