"""Part of tessaline."""
