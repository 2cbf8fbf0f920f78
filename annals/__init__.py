"""annals: version-history analytics and corpus preparation on Spark."""
