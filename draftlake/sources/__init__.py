"""Where tables of drawings come from."""
