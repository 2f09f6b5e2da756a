"""Where pages come from and where results go: archives, HTTP, files."""
