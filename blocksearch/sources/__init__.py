"""Where blocks come from."""
