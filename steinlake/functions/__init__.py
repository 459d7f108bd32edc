"""Column expressions: arrays, kernels, models, sequences, hash randomness."""
