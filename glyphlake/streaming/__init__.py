"""Text functions over streams."""
