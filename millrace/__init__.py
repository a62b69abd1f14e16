"""millrace: a Spark-native relational analytics engine."""
