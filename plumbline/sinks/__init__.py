"""Writers for catalog tables and files."""
