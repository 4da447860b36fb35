"""Reading, writing and the fixture views."""
