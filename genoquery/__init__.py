"""genoquery: a PySpark-native engine for genotype, variant and training-text data."""
