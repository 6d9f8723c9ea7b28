"""rankweave: graph ranking analytics and large-table data processing as PySpark plans."""
