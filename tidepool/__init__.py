"""A PySpark-native engine for finding passages from vague memories and for preparing text at scale."""
