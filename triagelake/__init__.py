"""A PySpark-native analytics engine for customer-service text tickets."""
