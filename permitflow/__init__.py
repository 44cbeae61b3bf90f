"""permitflow: a Spark-native engine for civic permit records."""
