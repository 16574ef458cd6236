"""Multi-channel signal, graph and evaluation analytics as Spark DataFrame functions."""
