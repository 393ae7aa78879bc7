"""Training-data operators on texts and vectors. Nothing outside this subpackage imports it."""
