"""Files of a store: manifest versions, log segments, sorted tables and value batches."""
