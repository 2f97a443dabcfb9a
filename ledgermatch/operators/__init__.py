"""DataFrame operators shared by the derived datasets."""
