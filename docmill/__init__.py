"""docmill: document analytics and batch hybrid retrieval as Spark jobs."""
