"""paperloom: scholarly-library analytics and corpus preparation as plain PySpark jobs."""
