"""Column functions: text, Markdown, URLs, addresses, classification and quality."""
