"""Scoring streams with a fitted model; an addition of ours."""
