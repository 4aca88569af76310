"""A PySpark-native engine for curating, synthesising and scoring annotated training data."""
