"""End-to-end plans: from pages to index tables, and search over them."""
