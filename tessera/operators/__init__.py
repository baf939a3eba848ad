"""Relational operators: quorum, frontier, graph, search, extraction, trust."""
