"""End-to-end jobs and the bridge from the driver's tables to the model."""
