"""Tables of documents, postings, keys and audit entries, and the key table."""
