"""Constant tables and plans built from them."""
