"""A PySpark-native engine that repairs a clustering of sequence fragments, plus corpus operators in ``spindrift.llm``."""
