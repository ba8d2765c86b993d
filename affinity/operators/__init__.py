"""The recommender's operators as DataFrame transformations."""
