"""Test-stand telemetry analytics on Spark: decode, convert, analyse, calibrate, command logs."""
