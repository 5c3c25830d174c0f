"""Training-data operators on text. Nothing outside this subpackage imports it."""
