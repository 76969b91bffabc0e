"""Every operator as a query on the given tables, with the SQL it must agree with."""
