"""wavetide: signal and time-frequency analytics on Apache Spark."""
