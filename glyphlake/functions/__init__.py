"""Text functions: each takes and gives Spark columns.  Null gives null; an empty text stays empty; "no answer" is null."""
