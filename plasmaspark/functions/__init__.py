"""Part of the fragmentomics engine; see README.md."""
