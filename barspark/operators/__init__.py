"""DataFrame to DataFrame operators; ``symbol`` and ``ts`` are the key and the order unless said otherwise."""
