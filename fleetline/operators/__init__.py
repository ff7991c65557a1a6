"""DataFrame -> DataFrame operators (all lazy)."""
