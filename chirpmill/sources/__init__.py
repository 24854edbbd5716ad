"""Tables in, reports out."""
