"""Incremental runs over growing archives; an extension, for archives that never end."""
