"""winnow: curation of text-record corpora and ranking analytics on PySpark."""
