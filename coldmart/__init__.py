"""A Spark-native engine for irregular, held-until-next device telemetry."""
