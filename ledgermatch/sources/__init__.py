"""Reading datasets from databases and files, and landing them."""
