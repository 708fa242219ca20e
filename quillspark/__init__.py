"""quillspark: French bank-identity and 2D barcode extraction, scoring and synthesis on Spark."""
