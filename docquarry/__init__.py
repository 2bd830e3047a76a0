"""docquarry: a Spark-native engine for document retrieval, grounding and corpus preparation."""
