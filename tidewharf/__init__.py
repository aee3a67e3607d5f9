"""Data-warehouse jobs on PySpark: sources, SQL transforms, sinks, a star
schema generator and a decision-support workload with recorded timings."""
