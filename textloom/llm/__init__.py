"""Training-data operators: counting, mixing, tokenising, deduplication, redaction and quality.

Each module holds one operator with its own general interface; ``queries`` holds the thin queries.
Nothing outside this subpackage imports it.
"""
