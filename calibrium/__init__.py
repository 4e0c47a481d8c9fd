"""Decision-calibration analytics and corpus operators on Spark."""
