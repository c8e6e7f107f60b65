"""harrow: a PySpark-native engine for agent-trace analytics and corpus preparation."""
