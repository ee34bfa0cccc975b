"""The request service as streams."""
