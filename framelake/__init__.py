"""PySpark library for preparing and evaluating frame and clip data sets."""
