"""quillmill: document and reading analytics as Spark DataFrame plans."""
