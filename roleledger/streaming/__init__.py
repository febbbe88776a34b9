"""The same operators on landed files as they arrive."""
