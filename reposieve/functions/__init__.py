"""Column functions: paths, globs, text spans, entropy, hosts, names."""
