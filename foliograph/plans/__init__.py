"""Query catalogues: named queries with the SQL they are checked against."""
