"""Query catalogue: driver tables read as river data, with the SQL each query must equal."""
