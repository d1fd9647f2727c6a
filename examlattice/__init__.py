"""A question bank and learner analytics library for Spark."""
