"""The operators put together over whole tables."""
