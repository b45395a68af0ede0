"""Column functions: text features, recodes and the numeric helpers of the tests."""
