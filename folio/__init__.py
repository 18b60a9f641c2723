"""folio: document-compliance analytics on Spark DataFrames."""
