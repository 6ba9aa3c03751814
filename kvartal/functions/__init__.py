"""Column expressions: every one is native, none crosses into Python."""
