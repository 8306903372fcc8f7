"""Column expressions: media scalars, enum decoding, vectors and hashes, signatures."""
