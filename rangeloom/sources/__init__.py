"""Tables as lists and bags."""
