"""Recipe analytics and recommendation as set-based PySpark operators."""
