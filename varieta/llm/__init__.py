"""Training-data operators for very large text collections."""
