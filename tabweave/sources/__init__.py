"""Reading raw tables, exercises and uploads, and building the cell index."""
