"""A PySpark-native engine for panels of judges: error dependence, routing policies, retrieval, and data-quality operators."""
