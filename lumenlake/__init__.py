"""A PySpark-native engine for image-feature tables and the evaluation of classifiers on them."""
