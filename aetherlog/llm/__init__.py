"""Operators that turn large transcript, page and capture collections into training data."""
