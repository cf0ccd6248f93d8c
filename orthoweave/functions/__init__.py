"""Column expressions; all stay in the JVM but for NFKC of non-ASCII text and model scores."""
