"""Column functions: text, URLs, hashes, prices, vectors, markup."""
