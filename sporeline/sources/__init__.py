"""Where graphs come from: tables, files, generators; and tables in the shared folder."""
