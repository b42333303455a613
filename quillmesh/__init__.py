"""quillmesh: a document-feed analytics engine on PySpark DataFrames."""
